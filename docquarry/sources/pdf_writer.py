"""Small valid PDF files, for round-trip tests and queries: bytes from a row, the same for the same row."""

from __future__ import annotations

import hashlib

from docquarry.codecs import filters
from docquarry.codecs.escapes import escape_string
from docquarry.sources import pdf_crypto

CHAINS = ([], ["FlateDecode"], ["ASCIIHexDecode", "FlateDecode"], ["RunLengthDecode"])
_HEAD = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n"


def _stream(encoded: bytes, chain: list[str], secret=bytes, more: str = "") -> bytes:
    data = secret(encoded)
    names = f"/Filter [ {' '.join('/' + n for n in chain)} ] " if chain else ""
    return f"<< {more}{names}/Length {len(data)} >>\nstream\n".encode() + data + b"\nendstream"


class _Lock:
    """Encryption of one file: what hides the bytes of an object, and the entries that say so."""

    def __init__(self, payload: bytes, password: bytes | None, owner: bytes, cipher: str):
        self.on, self.cipher, self.ready = password is not None, cipher, {}
        if not self.on:
            return
        self.id = hashlib.md5(payload).digest()
        self.revision = 4 if cipher == "aes" else 3
        self.owner = pdf_crypto.owner_entry(owner, password, self.revision, 16)
        self.key = pdf_crypto.file_key(password, self.owner, -4, self.id, self.revision, 16)

    def asked(self) -> tuple[bytes, bytes, int]:
        return self.key, self.id, self.revision

    def say(self, user: bytes) -> None:
        how = "/V 4 /R 4 /Length 128 /CF << /StdCF << /CFM /AESV2 /AuthEvent /DocOpen /Length 16 >> >> /StmF /StdCF /StrF /StdCF" if self.cipher == "aes" else "/V 2 /R 3 /Length 128"
        self.entry = f"<< /Filter /Standard {how} /P -4 /O <{self.owner.hex()}> /U <{user.hex()}> >>".encode()

    def of(self, number: int):
        if not self.on:
            return bytes
        if self.cipher != "aes":
            return lambda data: pdf_crypto.rc4(data, pdf_crypto.object_key(self.key, number, 0, False))
        return lambda data: self.ready[number, data]

    def job(self, number: int, data: bytes) -> tuple[bytes, bytes, bytes]:
        """Data, key and first block of what AES hides of an object."""
        return data, pdf_crypto.object_key(self.key, number, 0, True), hashlib.md5(self.id + number.to_bytes(4, "little")).digest()

    def string(self, text: str, number: int) -> str:
        return f"({escape_string(text)})" if not self.on else f"<{self.of(number)(_latin(text)).hex()}>"

    def trailer(self, number: int) -> str:
        return f" /Encrypt {number} 0 R /ID [ <{self.id.hex()}> <{self.id.hex()}> ]" if self.on else ""


def _latin(text: str) -> bytes:
    return text.encode("latin-1", "replace")


def _bodies(lock: _Lock, uri: str, title: str, script: int | None) -> list[bytes]:
    """Catalog, pages, page, (content stream), information, link."""
    act = f" /OpenAction << /S /JavaScript /JS {script} 0 R >>" if script else ""
    page = "<< /Type /Page /Parent 2 0 R /MediaBox [ 0 0 612 792 ] /Contents 4 0 R /Annots [ 6 0 R ] >>"
    link = f"<< /Type /Annot /Subtype /Link /Rect [ 0 0 9 9 ] /A << /Type /Action /S /URI /URI {lock.string(uri, 6)} >> >>"
    texts = [f"<< /Type /Catalog /Pages 2 0 R{act} >>", "<< /Type /Pages /Kids [ 3 0 R ] /Count 1 >>", page, "", f"<< /Title {lock.string(title, 5)} >>", link]
    return [_latin(t) for t in texts]


class _Draft:
    """A file before it is written: its lock, and its streams encoded."""

    def __init__(self, payload: bytes, *, chain: list[str], uri: str, title: str = "", update: bytes | None = None, password: bytes | None = None, owner: bytes = b"owner", cipher: str = "rc4", script: bytes | None = None):
        self.lock, self.chain, self.uri, self.title = _Lock(payload, password, owner, cipher), chain, uri, title
        self.payload = filters.encode(payload, chain)
        self.script, self.update = (None if x is None else filters.encode(x, ["FlateDecode"]) for x in (script, update))

    def hidden(self) -> list[tuple[int, bytes]]:
        """Object and bytes of all that AES hides."""
        if not self.lock.on or self.lock.cipher != "aes":
            return []
        found = [(6, _latin(self.uri)), (5, _latin(self.title)), (4, self.payload), (7, self.script), (4, self.update)]
        return [x for x in found if x[1] is not None]

    def written(self) -> bytes:
        lock, script, update = self.lock, self.script, self.update
        bodies = _bodies(lock, self.uri, self.title, 7 if script is not None else None)
        bodies[3] = _stream(self.payload, self.chain, lock.of(4))
        if script is not None:
            bodies.append(_stream(script, ["FlateDecode"], lock.of(7)))
        if lock.on:
            bodies.append(lock.entry)
        more = lock.trailer(len(bodies))
        out = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n")
        places = []
        for i, body in enumerate(bodies, 1):
            places.append(len(out))
            out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
        table = len(out)
        out += f"xref\n0 {len(bodies) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
        out += f"trailer\n<< /Size {len(bodies) + 1} /Root 1 0 R /Info 5 0 R{more} >>\nstartxref\n{table}\n%%EOF\n".encode()
        if update is not None:
            place = len(out)
            out += b"4 0 obj\n" + _stream(update, ["FlateDecode"], lock.of(4)) + b"\nendobj\n"
            second = len(out)
            out += f"xref\n4 1\n{place:010d} 00000 n \ntrailer\n<< /Size {len(bodies) + 1} /Root 1 0 R /Info 5 0 R /Prev {table}{more} >>\nstartxref\n{second}\n%%EOF\n".encode()
        return bytes(out)


def build(payload: bytes, **how) -> bytes:
    """Catalog, pages, page, content stream, information, link; with update, a second version that redefines the stream.

    how: chain and uri; title, update, password, owner, cipher, script. With a
    password, strings and streams are encrypted with 128 bits by RC4 or, with
    cipher "aes", by AES. A script becomes object 7, which the catalog opens.
    """
    return build_many([{"payload": payload, **how}])[0]


def build_many(files: list[dict]) -> list[bytes]:
    """build() of each; the keys of all of them are made side by side, and what AES hides is encrypted so."""
    drafts = [_Draft(**f) for f in files]
    locks = [d.lock for d in drafts if d.lock.on]
    users = pdf_crypto.user_entries([lock.asked() for lock in locks])
    for lock in locks:
        lock.say(users[lock.asked()])
    jobs = [(d.lock, number, data) for d in drafts for number, data in d.hidden()]
    asked = [lock.job(number, data) for lock, number, data in jobs]
    for (lock, number, data), (_, _, iv), made in zip(jobs, asked, pdf_crypto.aes_cbc_encrypt_many(asked), strict=True):
        lock.ready[number, data] = iv + made
    return [d.written() for d in drafts]


def build_compressed(payload: bytes, *, chain: list[str], uri: str, title: str = "") -> bytes:
    """The same document, all but the content stream in an object stream (8), with a cross-reference stream (9) in two ranges."""
    lock = _Lock(payload, None, b"", "rc4")
    bodies = _bodies(lock, uri, title, None)
    inside = [1, 2, 3, 5, 6]
    head, body = [], b""
    for number in inside:
        head.append(f"{number} {len(body)}")
        body += bodies[number - 1] + b" "
    first = " ".join(head).encode() + b" "
    out = bytearray(_HEAD)
    places = {}
    for number, data in ((4, _stream(filters.encode(payload, chain), chain)), (8, _stream(filters.encode(first + body, ["FlateDecode"]), ["FlateDecode"], more=f"/Type /ObjStm /N {len(inside)} /First {len(first)} "))):
        places[number] = len(out)
        out += f"{number} 0 obj\n".encode() + data + b"\nendobj\n"
    places[9] = len(out)
    rows = b"".join(b"\x00" + bytes(4) + b"\xff\xff" if n == 0 else b"\x01" + places[n].to_bytes(4, "big") + b"\x00\x00" if n in places else b"\x02" + (8).to_bytes(4, "big") + inside.index(n).to_bytes(2, "big") for n in [*range(7), 8, 9])
    out += b"9 0 obj\n" + _stream(filters.encode(rows, ["FlateDecode"]), ["FlateDecode"], more="/Type /XRef /Size 10 /W [ 1 4 2 ] /Index [ 0 7 8 2 ] /Root 1 0 R /Info 5 0 R ") + b"\nendobj\n"
    out += f"startxref\n{places[9]}\n%%EOF\n".encode()
    return bytes(out)
