"""A PDF file as records: header, versions, objects, entries, edges, cross-reference entries, trailers.

Written from the format's specification. parse() is a pure function of the bytes
and options; a fault becomes an error text on the file or object, or, with
strict=True, an exception. Values are small tuples (kind, value):

    ("dictionary", {name: value}) ("array", [value]) ("reference", (id, gen))
    ("name", "/X") ("string", bytes) ("hexstring", bytes) ("integer", int)
    ("real", float) ("bool", bool) ("null", None)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from docquarry.codecs import filters
from docquarry.codecs.escapes import decode_name, unescape_string

#: Containers inside containers that are read, at most.
DEPTH = 100
_SPACE = b"\x00\t\n\x0c\r "
_DELIMITERS = b"()<>[]{}/%"
_REGULAR_END = re.compile(rb"[\x00\t\n\x0c\r ()<>\[\]{}/%]")
_NOT_SPACE = re.compile(rb"[^\x00\t\n\x0c\r ]")
_REFERENCE = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+R(?![A-Za-z0-9])")
_HEADER = re.compile(rb"(\d{1,10})[\x00\t\n\x0c\r ]+(\d{1,5})[\x00\t\n\x0c\r ]+obj(?![A-Za-z])")
_INTEGER = re.compile(rb"[+-]?\d+")
_XREF, _TRAILER = re.compile(rb"xref[\x00\t\n\x0c\r ]+(?=\d)"), re.compile(rb"trailer[\x00\t\n\x0c\r ]*(?=<<)")
_STARTXREF = re.compile(rb"[\x00\t\n\x0c\r ]*startxref[\x00\t\n\x0c\r ]+(\d+)")
_SECTION, _ENTRY = re.compile(rb"[\x00\t\n\x0c\r ]*(\d+) (\d+)[\t ]*[\r\n]+"), re.compile(rb"(\d{10}) (\d{5}) ([nf])[\x00\t\n\x0c\r ]{1,2}")
_TEXT_REFERENCE = re.compile(rb"(\d{1,5})\s{1,3}(\d{1,5})\s{1,3}R")


class PdfError(ValueError):
    pass


class Cursor:
    """Reads values from bytes by position; nothing is copied but the values."""

    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else end

    def skip(self) -> None:
        data, at, end = self.data, self.at, self.end
        if at < end and data[at] > 37:  # neither space nor comment
            return
        if at + 1 < end and data[at] in _SPACE and data[at + 1] > 37:
            self.at = at + 1
            return
        while True:
            found = _NOT_SPACE.search(self.data, self.at, self.end)
            self.at = found.start() if found else self.end
            if self.at < self.end and self.data[self.at] == 37:  # a comment
                stops = [x for x in (self.data.find(b"\n", self.at, self.end), self.data.find(b"\r", self.at, self.end)) if x >= 0]
                self.at = min(stops, default=self.end)
                continue
            return

    def value(self, depth: int = 0):
        if depth > DEPTH:
            raise PdfError("values are nested too deeply")
        self.skip()
        data, at = self.data, self.at
        if at >= self.end:
            raise PdfError("value missing")
        c = data[at]
        if c == 47:  # name
            self.at += 1
            return "name", decode_name("/" + self._regular().decode("latin-1"))
        if c == 60 and data[at : at + 2] == b"<<":
            return self._dictionary(depth)
        if c == 40:
            return "string", self._string()
        if c == 60:
            stop = data.find(b">", at, self.end)
            if stop < 0:
                raise PdfError("hexadecimal string is not closed")
            self.at = stop + 1
            digits = data[at + 1 : stop].translate(None, _SPACE)
            try:
                return "hexstring", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("latin-1"))
            except ValueError:
                raise PdfError("bad hexadecimal string") from None
        if c == 91:
            self.at += 1
            items = []
            while True:
                self.skip()
                if self.at >= self.end:
                    raise PdfError("array is not closed")
                if data[self.at] == 93:
                    self.at += 1
                    return "array", items
                items.append(self.value(depth + 1))
        reference = _REFERENCE.match(data, at, self.end) if 48 <= c <= 57 else None
        if reference:
            self.at = reference.end()
            return "reference", (int(reference[1]), int(reference[2]))
        word = self._regular()
        if word in (b"true", b"false"):
            return "bool", word == b"true"
        if word == b"null":
            return "null", None
        try:
            return ("integer", int(word)) if _INTEGER.fullmatch(word) else ("real", float(word))
        except ValueError:
            if not word:
                self.at += 1
            raise PdfError(f"unknown token {word[:20]!r}") from None

    def _regular(self) -> bytes:
        found = _REGULAR_END.search(self.data, self.at, self.end)
        stop = found.start() if found else self.end
        word = self.data[self.at : stop]
        self.at = stop
        return word

    def _dictionary(self, depth: int):
        self.at += 2
        out = {}
        while True:
            self.skip()
            if self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return "dictionary", out
            if self.at >= self.end:
                raise PdfError("dictionary is not closed")
            key = self.value(depth + 1)
            if key[0] != "name":
                raise PdfError("dictionary key is no name")
            self.skip()
            out[key[1]] = ("null", None) if self.data[self.at : self.at + 2] == b">>" else self.value(depth + 1)

    def _string(self) -> bytes:
        data, at, level = self.data, self.at + 1, 1
        start = at
        while at < self.end:
            c = data[at]
            if c == 92:
                at += 2
                continue
            level += (c == 40) - (c == 41)
            if not level:
                self.at = at + 1
                return unescape_string(data[start:at].decode("latin-1")).encode("latin-1", "replace")
            at += 1
        raise PdfError("string is not closed")


@dataclass
class Obj:
    """An indirect object of one version."""

    version: int
    object_id: int
    gen: int
    offset: int
    size: int
    value: tuple | None = None
    raw: bytes = b""
    stream: bytes | None = None
    decoded: bytes | None = None
    filters: list[str] = field(default_factory=list)
    compressed_in: int | None = None
    errors: list[str] = field(default_factory=list)

    @property
    def entries(self) -> dict:
        return self.value[1] if self.value and self.value[0] == "dictionary" else {}

    @property
    def kind(self) -> str:
        if self.value is None:
            return "unknown"
        return "stream" if self.stream is not None else self.value[0]

    @property
    def dict_type(self) -> str:
        """/Type, then /Action and /S where there is one."""
        kind, action = self.entries.get("/Type", ("", ""))[1], self.entries.get("/S", ("", ""))
        action = action[1] if action[0] == "name" else ""
        return " ".join(x for x in (kind if isinstance(kind, str) else "", f"/Action {action}" if action and not kind else action) if x)


@dataclass
class File:
    size: int
    md5: str
    sha1: str
    sha256: str
    pdf_version: str | None = None
    header_offset: int = 0
    binary: bool = False
    linearized: bool = False
    encrypted: bool = False
    versions: list[tuple[int, int, int]] = field(default_factory=list)  # number, offset, length
    objects: list[Obj] = field(default_factory=list)
    xref: list[tuple[int, int, str, int, int, bool]] = field(default_factory=list)  # version, id, kind, offset, gen, from a stream
    trailers: list[tuple[int, bool, dict, int | None]] = field(default_factory=list)  # version, from a stream, entries, startxref
    errors: list[str] = field(default_factory=list)


def references(value, depth: int = 0):
    """(id, gen) of each reference in a value, in order."""
    if value is None or depth > DEPTH:
        return
    kind, inner = value
    if kind == "reference":
        yield inner
    elif kind == "array":
        for x in inner:
            yield from references(x, depth + 1)
    elif kind == "dictionary":
        for x in inner.values():
            yield from references(x, depth + 1)


def text_of(value, depth: int = 0) -> str:
    """A value in the format's own notation, as text of one character per byte."""
    if value is None:
        return ""
    kind, inner = value
    if kind == "dictionary":
        return "<< " + " ".join(f"{k} {text_of(v, depth + 1)}" for k, v in inner.items()) + " >>"
    if kind == "array":
        return "[ " + " ".join(text_of(v, depth + 1) for v in inner) + " ]"
    if kind == "reference":
        return f"{inner[0]} {inner[1]} R"
    if kind == "string":
        return "(" + inner.decode("latin-1") + ")"
    if kind == "hexstring":
        return "<" + inner.hex() + ">"
    if kind == "bool":
        return "true" if inner else "false"
    return "null" if kind == "null" else str(inner)


def segments(data: bytes) -> list[tuple[int, int]]:
    """(offset, length) of each version: up to an end-of-file mark and its line end. Without a mark, all is one."""
    out, start = [], 0
    for m in re.finditer(rb"%%EOF(?:\r\n|\r|\n)?", data):
        out.append((start, m.end() - start))
        start = m.end()
    return out or [(0, len(data))]


def parse(data: bytes, *, strict: bool = False, loose: bool = False, password: bytes = b"", limit: int = filters.LIMIT, decode: bool = True) -> File:
    """All versions of a file. loose: an object ends where the next one begins, whether or not endobj stands there.

    Without decode only object and cross-reference streams are decoded, which hold the file's structure.
    """
    return next(parse_many([data], strict=strict, loose=loose, password=password, limit=limit, decode=decode))


def parse_many(contents: list[bytes], *, strict: bool = False, loose: bool = False, password: bytes = b"", limit: int = filters.LIMIT, decode: bool = True) -> Iterator[File]:
    """parse() of each, in order; passwords of encrypted files are tried side by side."""
    opened = [_opened(data, strict, loose, limit) for data in contents]
    locked = [(f, encrypt) for f, encrypt in opened if encrypt]
    known = {}
    if locked:
        from docquarry.sources.pdf_crypto import entries_of_users

        known = entries_of_users(locked, password)
        locked.clear()
    opened.reverse()
    while opened:
        yield _closed(*opened.pop(), strict, password, limit, decode, known)


def _fault(out: File, strict: bool, text: str) -> None:
    if strict:
        raise PdfError(text)
    if text not in out.errors:
        out.errors.append(text)


def _opened(data: bytes, strict: bool, loose: bool, limit: int) -> tuple[File, tuple | None]:
    """A file's versions and objects as they stand there, and its encryption dictionary or a reference to it."""
    out = File(len(data), hashlib.md5(data).hexdigest(), hashlib.sha1(data).hexdigest(), hashlib.sha256(data).hexdigest())

    def fault(text: str) -> None:
        _fault(out, strict, text)

    head = re.search(rb"%(?:PDF-|!PS-Adobe-\d\.\d PDF-)(\d\.\d)", data[: 1 << 20])
    if head:
        out.pdf_version, out.header_offset = head[1].decode(), head.start()
        second = re.compile(rb"[\r\n]+%([^\r\n]{4})").match(data, head.end())
        out.binary = bool(second and min(second[1]) >= 128)
    else:
        fault("no header")
    if b"%%EOF" not in data:
        fault("no end-of-file mark")
    known: dict[int, Obj] = {}
    for version, (start, length) in enumerate(segments(data)):
        out.versions.append((version, start, length))
        _version(data, start, start + length, version, out, known, fault, loose, limit)
    return out, next((t[2]["/Encrypt"] for t in reversed(out.trailers) if "/Encrypt" in t[2]), None)


def _closed(out: File, encrypt: tuple | None, strict: bool, password: bytes, limit: int, decode: bool, known: dict) -> File:
    """The file decrypted and its streams decoded."""
    if encrypt:
        out.encrypted = True
        try:
            from docquarry.sources.pdf_crypto import decrypt_file

            decrypt_file(out, encrypt, password, known)
        except PdfError as e:
            _fault(out, strict, str(e))
    for o in out.objects:
        if o.stream is not None and o.compressed_in is None:
            if decode or o.entries.get("/Type") in (("name", "/ObjStm"), ("name", "/XRef")):
                _decode(o, limit)
            if o.entries.get("/Type") == ("name", "/ObjStm"):
                for inner in _unpack(o):
                    known[inner.object_id] = inner
                    out.objects.append(inner)
            elif o.entries.get("/Type") == ("name", "/XRef"):
                _xref_stream(o, out)
        if o.errors and strict:
            raise PdfError(f"object {o.object_id}: {o.errors[0]}")
        out.linearized |= o.version == 0 and "/Linearized" in o.entries
    return out


def _version(data, start, end, version, out, known, fault, loose, limit) -> None:
    at, next_end, m = start, start - 1, None

    def end_of(place: int) -> int:
        """The first endobj from a place on; the one found last serves as long as it lies there."""
        nonlocal next_end
        if next_end is not None and next_end < place:
            found = data.find(b"endobj", place, end)
            next_end = found if found >= 0 else None
        return -1 if next_end is None else next_end

    while True:
        m = m or _HEADER.search(data, at, end)
        if not m:
            break
        o = Obj(version, int(m[1]), int(m[2]), m.start(), 0)
        cursor = Cursor(data, m.end(), end)
        try:
            o.value = cursor.value()
        except PdfError as e:
            o.errors.append(str(e))
        after = cursor.at
        cursor.skip()
        if data[cursor.at : cursor.at + 6] == b"stream" and o.entries is not None and o.value and o.value[0] == "dictionary":
            body = cursor.at + 6
            body += 2 if data[body : body + 2] == b"\r\n" else 1 if data[body : body + 1] in b"\r\n" else 0
            declared = o.entries.get("/Length", ("null", None))
            if declared[0] == "reference":
                target = known.get(declared[1][0])
                declared = target.value if target and target.value else ("null", None)
            last = body + declared[1] if declared[0] == "integer" and declared[1] >= 0 else -1
            if last < 0 or last > end or not data[last : last + 11].lstrip(_SPACE).startswith(b"endstream"):
                found = data.find(b"endstream", body, end)
                if last >= 0 and declared[0] == "integer":
                    o.errors.append("declared length is wrong")
                if found < 0:
                    o.errors.append("endstream missing")
                    stop = end_of(after)
                    found = stop if stop >= 0 else end
                last = found
                if data[last - 2 : last] == b"\r\n":
                    last -= 2
                elif data[last - 1 : last] in (b"\n", b"\r"):
                    last -= 1
                last = max(last, body)
            o.stream = data[body:last]
            after = last
        stop = end_of(after)
        # without loose, one that begins beyond the end does not matter; the byte there may be part of a word
        following = _HEADER.search(data, after, end if loose or stop < 0 else min(stop + 1, end))
        if loose or stop < 0 or following and following.start() < stop:
            if not loose:
                o.errors.append("endobj missing")
            close = following.start() if following else (stop if stop >= 0 else end)
            if stop >= 0 and stop < close:
                close = stop + 6
        else:
            close = stop + 6
        o.size, o.raw = close - o.offset, data[o.offset : close]
        known[o.object_id] = o
        out.objects.append(o)
        at = max(close, m.end())
        m = following if following and following.start() == at else None
    for m in _XREF.finditer(data, start, end):
        if m.start() == start or not data[m.start() - 1 : m.start()].isalpha():
            _xref_table(data, m.end(), end, version, out)
    for m in _TRAILER.finditer(data, start, end):
        cursor = Cursor(data, m.end(), end)
        try:
            entries = cursor.value()[1]
        except PdfError as e:
            fault(f"trailer: {e}")
            continue
        s = _STARTXREF.match(data, cursor.at, end)
        out.trailers.append((version, False, entries, int(s[1]) if s else None))


def _xref_table(data: bytes, at: int, end: int, version: int, out: File) -> None:
    while m := _SECTION.match(data, at, end):
        at = m.end()
        for i in range(int(m[2])):
            e = _ENTRY.match(data, at, end)
            if not e:
                return
            out.xref.append((version, int(m[1]) + i, "free" if e[3] == b"f" else "used", int(e[1]), int(e[2]), False))
            at = e.end()


def _number(o: Obj, key: str, default: int) -> int:
    kind, value = o.entries.get(key, ("null", None))
    return value if kind == "integer" else default


def _xref_stream(o: Obj, out: File) -> None:
    """Entries of fixed width; ranges of /Index follow one another."""
    widths = [x[1] for x in o.entries.get("/W", ("array", []))[1] if x[0] == "integer"]
    if len(widths) != 3 or min(widths) < 0 or not sum(widths) or sum(widths) > 24:
        o.errors.append("bad widths of a cross-reference stream")
        return
    index = [x[1] for x in o.entries.get("/Index", ("array", []))[1] if x[0] == "integer"] or [0, _number(o, "/Size", 0)]
    data, at = o.decoded or b"", 0
    for first, count in zip(index[::2], index[1::2], strict=False):
        for i in range(count):
            row = data[at : at + sum(widths)]
            if len(row) < sum(widths):
                o.errors.append("cross-reference stream ends early")
                return
            at += len(row)
            a, b = widths[0], widths[0] + widths[1]
            kind = int.from_bytes(row[:a], "big") if a else 1
            out.xref.append((o.version, first + i, {0: "free", 1: "used", 2: "compressed"}.get(kind, "unknown"), int.from_bytes(row[a:b], "big"), int.from_bytes(row[b:], "big"), True))
    out.trailers.append((o.version, True, {k: v for k, v in o.entries.items() if k in ("/Size", "/Prev", "/Root", "/Encrypt", "/Info", "/ID")}, None))


def _plain(value):
    kind, inner = value
    return inner.lstrip("/") if kind == "name" else inner if kind in ("integer", "bool", "real") else None


def _decode(o: Obj, limit: int) -> None:
    names = o.entries.get("/Filter", o.entries.get("/F", ("null", None)))
    names = [names] if names[0] == "name" else names[1] if names[0] == "array" else []
    params = o.entries.get("/DecodeParms", o.entries.get("/DP", ("null", None)))
    params = [params] if params[0] == "dictionary" else params[1] if params[0] == "array" else []
    o.filters = [n[1] for n in names if n[0] == "name"]
    o.decoded, error = filters.decode(o.stream or b"", o.filters, [{k.lstrip("/"): _plain(v) for k, v in p[1].items()} if p[0] == "dictionary" else None for p in params], limit)
    if error:
        o.errors.append(error)


def _unpack(o: Obj) -> list[Obj]:
    """The objects in an object stream: pairs of id and offset, then the values."""
    data, first, out = o.decoded or b"", _number(o, "/First", 0), []
    pairs = [int(x) for x in re.findall(rb"\d+", data[:first])][: 2 * _number(o, "/N", 0)]
    for object_id, at in zip(pairs[::2], pairs[1::2], strict=False):
        inner = Obj(o.version, object_id, 0, at, 0, compressed_in=o.object_id)
        cursor = Cursor(data, first + at)
        try:
            inner.value = cursor.value()
        except PdfError as e:
            inner.errors.append(str(e))
        inner.raw = data[first + at : cursor.at]
        inner.size = len(inner.raw)
        out.append(inner)
    return out


def edges(o: Obj) -> list[tuple[int, int, int, str]]:
    """(ord, id, gen, origin): from the value's elements, then from the text of a decoded stream."""
    out = [(i, a, b, "element") for i, (a, b) in enumerate(references(o.value))]
    if o.decoded and o.entries.get("/Type") not in (("name", "/ObjStm"), ("name", "/XRef")):
        out += [(len(out) + i, int(a), int(b), "stream_text") for i, (a, b) in enumerate(dict.fromkeys(_TEXT_REFERENCE.findall(o.decoded)))]
    return out


def page_text(decoded: bytes) -> str:
    """The strings that a content stream shows."""
    out = []
    for m in re.finditer(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|'|\")|\[((?:[^\]\\]|\\.)*)\]\s*TJ", decoded, re.S):
        if m[1] is not None:
            out.append(unescape_string(m[1].decode("latin-1")))
        else:
            out.append("".join(unescape_string(s.decode("latin-1")) for s in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", m[2], re.S)))
    return "\n".join(out)
