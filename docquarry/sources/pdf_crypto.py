"""The standard security handler: keys, RC4 and AES-CBC, as ISO 32000 defines them."""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np

from docquarry.sources.pdf_syntax import File, PdfError

# fixed value: what fills a password up to 32 bytes
PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")


def rc4(data: bytes, key: bytes) -> bytes:
    s, j, long = list(range(256)), 0, key * (255 // len(key) + 1)
    for i in range(256):
        x = s[i]
        j = (j + x + long[i]) & 255
        s[i], s[j] = s[j], x
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        x = s[i]
        j = (j + x) & 255
        s[i] = y = s[j]
        s[j] = x
        out[n] = c ^ s[(x + y) & 255]
    return bytes(out)


def _tables() -> tuple[list[int], list[int]]:
    """The substitution box and its inverse, from inverses in the field of 256 elements."""
    exp, log, x = [0] * 256, [0] * 256, 1
    for i in range(255):
        exp[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
        x &= 255
    box = [0] * 256
    for v in range(256):
        b = exp[(255 - log[v]) % 255] if v else 0
        r = b
        for k in range(1, 5):
            r ^= (b << k | b >> (8 - k)) & 255
        box[v] = r ^ 0x63
    inverse = [0] * 256
    for i, v in enumerate(box):
        inverse[v] = i
    return box, inverse


_BOX, _INVERSE = _tables()


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _column_tables(box: list[int], factors: tuple[int, int, int, int]) -> np.ndarray:
    """Four tables: what a byte, substituted, adds to its column by its place there; an entry is the column's bytes in order."""
    one = np.stack([np.array([_times(v, k) for v in box], np.uint8) for k in factors], axis=1)
    return np.stack([np.ascontiguousarray(np.roll(one, place, axis=1)).view(np.uint32)[:, 0] for place in range(4)])


# of a round forward and backward: for arrays in the machine's order of bytes, for single words with the first byte on top
_FORWARD, _BACKWARD = _column_tables(_BOX, (2, 1, 1, 3)), _column_tables(_INVERSE, (14, 9, 13, 11))
_FORWARD_WORDS, _BACKWARD_WORDS = ([[int.from_bytes(x.tobytes(), "big") for x in t] for t in tables] for tables in (_FORWARD, _BACKWARD))
_BOX_ARRAY, _INVERSE_ARRAY = np.array(_BOX, np.uint8), np.array(_INVERSE, np.uint8)
_SHIFT = np.array([(i + 4 * (i % 4)) % 16 for i in range(16)])
_UNSHIFT = np.array([(i - 4 * (i % 4)) % 16 for i in range(16)])
#: Texts, or blocks, from which arrays are faster than single words.
_LANES = 8


def _round_words(key: bytes) -> list[int]:
    n, box = len(key) // 4, _BOX
    words, rcon = list(struct.unpack(f">{n}I", key)), 1
    for i in range(n, 4 * (n + 7)):
        t = words[-1]
        if i % n == 0:
            t = (box[t >> 16 & 255] ^ rcon) << 24 | box[t >> 8 & 255] << 16 | box[t & 255] << 8 | box[t >> 24]
            rcon = _times(rcon, 2)
        elif n > 6 and i % n == 4:
            t = box[t >> 24] << 24 | box[t >> 16 & 255] << 16 | box[t >> 8 & 255] << 8 | box[t & 255]
        words.append(words[i - n] ^ t)
    return words


def _inverse_words(words: list[int]) -> list[int]:
    """Keys of the inverse cipher in the order of its rounds; those of inner rounds have their columns mixed back."""
    (t0, t1, t2, t3), box = _BACKWARD_WORDS, _BOX
    out = words[-4:]
    for at in range(len(words) - 8, 0, -4):
        out += [t0[box[w >> 24]] ^ t1[box[w >> 16 & 255]] ^ t2[box[w >> 8 & 255]] ^ t3[box[w & 255]] for w in words[at : at + 4]]
    return out + words[:4]


def _array_keys(words: list[int]) -> np.ndarray:
    """Rounds by four columns, in the machine's order of bytes."""
    return np.array(words, ">u4").view(np.uint32).reshape(-1, 4)


def _rounds(blocks: np.ndarray, keys: np.ndarray, tables: np.ndarray, box: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """All blocks (n, 4 columns) side by side; keys are (rounds, columns), or (rounds, n, columns) where each block has its own."""
    s = blocks ^ keys[0]
    for k in keys[1:-1]:
        b = s.view(np.uint8).take(shift, 1)
        s = tables[0].take(b[:, 0::4])
        for place in (1, 2, 3):
            s ^= tables[place].take(b[:, place::4])
        s ^= k
    return box.take(s.view(np.uint8).take(shift, 1)).view(np.uint32) ^ keys[-1]


def _decrypt_words(data: bytes, words: list[int], iv: bytes) -> bytes:
    (t0, t1, t2, t3), box, keys = _BACKWARD_WORDS, _INVERSE, _inverse_words(words)
    before, out = struct.unpack(">4I", iv), []
    for block in struct.iter_unpack(">4I", data):
        a, b, c, d = (x ^ k for x, k in zip(block, keys, strict=False))
        for at in range(4, len(keys) - 4, 4):
            a, b, c, d = (
                t0[a >> 24] ^ t1[d >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[b & 255] ^ keys[at],
                t0[b >> 24] ^ t1[a >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[c & 255] ^ keys[at + 1],
                t0[c >> 24] ^ t1[b >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[d & 255] ^ keys[at + 2],
                t0[d >> 24] ^ t1[c >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[a & 255] ^ keys[at + 3],
            )
        last = ((a, d, c, b), (b, a, d, c), (c, b, a, d), (d, c, b, a))
        out += [(box[w >> 24] << 24 | box[x >> 16 & 255] << 16 | box[y >> 8 & 255] << 8 | box[z & 255]) ^ k ^ p for (w, x, y, z), k, p in zip(last, keys[-4:], before, strict=True)]
        before = block
    return struct.pack(f">{len(out)}I", *out)


def _encrypt_words(data: bytes, words: list[int], iv: bytes) -> bytes:
    (t0, t1, t2, t3), box, inner, last = _FORWARD_WORDS, _BOX, words[4:-4], words[-4:]
    rounds = list(zip(*[iter(inner)] * 4, strict=True))
    k0, k1, k2, k3 = words[:4]
    a, b, c, d = struct.unpack(">4I", iv)
    out = []
    for e, f, g, h in struct.iter_unpack(">4I", data):
        a, b, c, d = a ^ e ^ k0, b ^ f ^ k1, c ^ g ^ k2, d ^ h ^ k3
        for e, f, g, h in rounds:
            a, b, c, d = (
                t0[a >> 24] ^ t1[b >> 16 & 255] ^ t2[c >> 8 & 255] ^ t3[d & 255] ^ e,
                t0[b >> 24] ^ t1[c >> 16 & 255] ^ t2[d >> 8 & 255] ^ t3[a & 255] ^ f,
                t0[c >> 24] ^ t1[d >> 16 & 255] ^ t2[a >> 8 & 255] ^ t3[b & 255] ^ g,
                t0[d >> 24] ^ t1[a >> 16 & 255] ^ t2[b >> 8 & 255] ^ t3[c & 255] ^ h,
            )
        a, b, c, d = (
            (box[a >> 24] << 24 | box[b >> 16 & 255] << 16 | box[c >> 8 & 255] << 8 | box[d & 255]) ^ last[0],
            (box[b >> 24] << 24 | box[c >> 16 & 255] << 16 | box[d >> 8 & 255] << 8 | box[a & 255]) ^ last[1],
            (box[c >> 24] << 24 | box[d >> 16 & 255] << 16 | box[a >> 8 & 255] << 8 | box[b & 255]) ^ last[2],
            (box[d >> 24] << 24 | box[a >> 16 & 255] << 16 | box[b >> 8 & 255] << 8 | box[c & 255]) ^ last[3],
        )
        out += (a, b, c, d)
    return struct.pack(f">{len(out)}I", *out)


def aes_cbc_decrypt(data: bytes, key: bytes, iv: bytes, unpad: bool = True) -> bytes:
    """All blocks side by side, a few one by one; bytes beyond the last whole block are left out."""
    n = len(data) // 16
    if not n:
        return b""
    words, iv = _round_words(key), iv.ljust(16, b"\x00")[:16]
    if n < _LANES:
        out = _decrypt_words(data[: 16 * n], words, iv)
    else:
        blocks = np.frombuffer(data, np.uint32, 4 * n).reshape(n, 4)
        before = np.concatenate((np.frombuffer(iv, np.uint32)[None, :], blocks[:-1]))
        out = (_rounds(blocks, _array_keys(_inverse_words(words)), _BACKWARD, _INVERSE_ARRAY, _UNSHIFT) ^ before).tobytes()
    if unpad and 1 <= out[-1] <= 16 and out.endswith(bytes([out[-1]]) * out[-1]):
        out = out[: -out[-1]]
    return out


def _padded(data: bytes) -> bytes:
    n = 16 - len(data) % 16
    return data + bytes([n]) * n


def aes_cbc_encrypt(data: bytes, key: bytes, iv: bytes, pad: bool = True) -> bytes:
    return _encrypt_words(_padded(data) if pad else data, _round_words(key), iv)


def aes_cbc_encrypt_many(jobs: list[tuple[bytes, bytes, bytes]]) -> list[bytes]:
    """aes_cbc_encrypt() of each (data, key, iv), keys of one length: the texts side by side, block after block, and the ends of the longest one by one."""
    order = sorted(range(len(jobs)), key=lambda i: -len(jobs[i][0]))
    texts = [_padded(jobs[i][0]) for i in order]
    words = [_round_words(jobs[i][1]) for i in order]
    ends = np.cumsum([len(t) // 16 for t in texts])
    starts, blocks = ends - [len(t) // 16 for t in texts], np.frombuffer(bytearray(b"".join(texts)), np.uint32).reshape(-1, 4)
    lengths = ends - starts
    at = 0
    if len(jobs) >= _LANES:
        keys = np.ascontiguousarray(np.stack([_array_keys(w) for w in words], axis=1))
        before = np.frombuffer(b"".join(jobs[i][2] for i in order), np.uint32).reshape(-1, 4)
        live = len(jobs)
        while True:
            while live and lengths[live - 1] <= at:
                live -= 1
            if live < _LANES:
                break
            if live < keys.shape[1]:
                keys = keys[:, :live]
            places = starts[:live] + at
            before = _rounds(blocks[places] ^ before[:live], keys, _FORWARD, _BOX_ARRAY, _SHIFT)
            blocks[places] = before
            at += 1
    out: list[bytes] = [b""] * len(jobs)
    for k, i in enumerate(order):
        done = blocks[starts[k] : min(starts[k] + at, ends[k])].tobytes()
        rest = texts[k][16 * at :]
        out[i] = done + (_encrypt_words(rest, words[k], done[-16:] or jobs[i][2]) if rest else b"")
    return out


def file_key(password: bytes, owner: bytes, permissions: int, file_id: bytes, revision: int, length: int, metadata: bool = True) -> bytes:
    """Revisions 2 to 4, from the user's password."""
    h = hashlib.md5((password + PADDING)[:32] + owner + (permissions & 0xFFFFFFFF).to_bytes(4, "little") + file_id)
    if revision >= 4 and not metadata:
        h.update(b"\xff\xff\xff\xff")
    key = h.digest()
    if revision >= 3:
        for _ in range(50):
            key = hashlib.md5(key[:length]).digest()
    return key[:length]


@lru_cache(1024)
def owner_entry(owner: bytes, user: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5((owner + PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:length]).digest()
    key, out = key[:length], (user + PADDING)[:32]
    for i in range(20 if revision >= 3 else 1):
        out = rc4(out, bytes(b ^ i for b in key))
    return out


def user_entry(key: bytes, file_id: bytes, revision: int) -> bytes:
    if revision == 2:
        return rc4(PADDING, key)
    out = hashlib.md5(PADDING + file_id).digest()
    for i in range(20):
        out = rc4(out, bytes(b ^ i for b in key))
    return out + bytes(16)


def _rc4_streams(keys: np.ndarray, n: int) -> np.ndarray:
    """The first n bytes that RC4 adds under each key; keys are columns, so is what is returned."""
    lanes = np.arange(keys.shape[1], dtype=np.int32)
    s = np.repeat(np.arange(256, dtype=np.uint8)[:, None], len(lanes), axis=1)
    flat, width, j = s.reshape(-1), np.int32(len(lanes)), np.zeros(len(lanes), np.uint8)

    def swap(i: int) -> tuple[np.ndarray, np.ndarray]:
        x = s[i].copy()
        places = j * width + lanes
        y = flat[places]
        flat[places] = x
        s[i] = y
        return x, y

    for i in range(256):
        j += s[i]
        j += keys[i % len(keys)]
        swap(i)
    j[:] = 0
    out = np.empty((n, len(lanes)), np.uint8)
    for k in range(n):
        i = (k + 1) & 255
        j += s[i]
        x, y = swap(i)
        out[k] = flat[(x + y) * width + lanes]
    return out


def user_entries(asked: list[tuple[bytes, bytes, int]]) -> dict[tuple[bytes, bytes, int], bytes]:
    """user_entry() of each (key, file id, revision), those of one length of key side by side."""
    out, alike = {}, {}
    for key, file_id, revision in asked:
        alike.setdefault(0 if revision == 2 else len(key), []).append((key, file_id, revision))
    for length, some in alike.items():
        if not length or len(some) < _LANES:
            out |= {x: user_entry(*x) for x in some}
            continue
        for at in range(0, len(some), 512):
            part = some[at : at + 512]
            keys = np.frombuffer(b"".join(x[0] for x in part), np.uint8).reshape(len(part), length)
            lanes = (keys[:, None, :] ^ np.arange(20, dtype=np.uint8)[None, :, None]).reshape(-1, length).T
            stream = np.bitwise_xor.reduce(_rc4_streams(np.ascontiguousarray(lanes), 16).reshape(16, len(part), 20), axis=2).T
            first = np.frombuffer(b"".join(hashlib.md5(PADDING + x[1]).digest() for x in part), np.uint8).reshape(-1, 16)
            out |= {x: row.tobytes() + bytes(16) for x, row in zip(part, first ^ stream, strict=True)}
    return out


@lru_cache(1024)
def user_password_of_owner(owner_password: bytes, owner: bytes, revision: int, length: int) -> bytes:
    key = hashlib.md5((owner_password + PADDING)[:32]).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:length]).digest()
    key, out = key[:length], owner
    for i in reversed(range(20 if revision >= 3 else 1)):
        out = rc4(out, bytes(b ^ i for b in key))
    return out


def object_key(key: bytes, object_id: int, gen: int, aes: bool) -> bytes:
    data = key + object_id.to_bytes(3, "little") + gen.to_bytes(2, "little") + (b"sAlT" if aes else b"")
    return hashlib.md5(data).digest()[: min(16, len(key) + 5)]


def _bytes(entries: dict, name: str) -> bytes:
    kind, value = entries.get(name, ("null", None))
    return value if kind in ("string", "hexstring") else b""


def _int(entries: dict, name: str, default: int) -> int:
    kind, value = entries.get(name, ("null", None))
    return value if kind == "integer" else default


def _handler(file: File, encrypt) -> tuple[dict, int | None]:
    """Entries of the encryption dictionary, and the object that it is."""
    if encrypt[0] != "reference":
        return encrypt[1], None
    found = [o for o in file.objects if o.object_id == encrypt[1][0]]
    return found[-1].entries if found else {}, encrypt[1][0]


def _key_length(entries: dict) -> int:
    v = _int(entries, "/V", 0)
    return 16 if v == 4 else _int(entries, "/Length", 40) // 8 if v != 1 else 5


def _candidates(file: File, entries: dict, password: bytes) -> list[tuple[bytes, bytes, int]]:
    """(key, file id, revision) if the password is the user's, and if it is the owner's."""
    r, length, owner = _int(entries, "/R", 2), _key_length(entries), _bytes(entries, "/O")
    if not 1 <= length <= 16:
        raise PdfError(f"keys of {length} bytes are not supported")
    metadata = entries.get("/EncryptMetadata", ("bool", True))[1]
    ids = next((t[2]["/ID"] for t in file.trailers if "/ID" in t[2]), ("array", []))[1]
    file_id = ids[0][1] if ids and ids[0][0] in ("string", "hexstring") else b""
    return [(file_key(p, owner[:32], _int(entries, "/P", 0), file_id, r, length, metadata), file_id, r) for p in (password, user_password_of_owner(password, owner, r, length))]


def entries_of_users(files: list[tuple[File, tuple]], password: bytes) -> dict:
    """What decrypt_file() compares, for several (file, its encryption) at once; files that it can't read are left to it."""
    asked = []
    for file, encrypt in files:
        try:
            entries, _ = _handler(file, encrypt)
            if entries.get("/Filter") == ("name", "/Standard") and _int(entries, "/V", 0) in (1, 2, 4):
                asked += _candidates(file, entries, password)
        except Exception:  # damaged entries; decrypt_file() meets them again
            continue
    return user_entries(asked)


def decrypt_file(file: File, encrypt, password: bytes, known: dict | None = None) -> None:
    """Strings and streams of every object, in place; PdfError if the handler or password is not usable."""
    entries, own = _handler(file, encrypt)
    if entries.get("/Filter") != ("name", "/Standard"):
        raise PdfError("security handler is not supported")
    v = _int(entries, "/V", 0)
    methods = {"/StmF": "V2", "/StrF": "V2"}  # of streams, and of strings
    if v in (4, 5):
        named = entries.get("/CF", ("dictionary", {}))[1]
        for use in methods:
            filter_ = named.get(entries.get(use, ("name", "/Identity"))[1], ("dictionary", {}))[1]
            methods[use] = filter_.get("/CFM", ("name", "/None"))[1].lstrip("/")
    elif v not in (1, 2):
        raise PdfError(f"encryption version {v} is not supported")
    metadata = entries.get("/EncryptMetadata", ("bool", True))[1]
    owner, user = _bytes(entries, "/O"), _bytes(entries, "/U")
    if v == 5:
        key = _key5(password, owner, user, entries)
    else:
        key = next((x[0] for x in _candidates(file, entries, password) if ((known or {}).get(x) or user_entry(*x))[:16] == user[:16]), None)
        if key is None:
            raise PdfError("password does not fit")

    def plain(data: bytes, o, method: str) -> bytes:
        if method in ("None", "Identity"):
            return data
        if method.startswith("AES"):
            k = key if v == 5 else object_key(key, o.object_id, o.gen, True)
            return aes_cbc_decrypt(data[16:], k, data[:16])
        return rc4(data, object_key(key, o.object_id, o.gen, False))

    def walk(value, o):
        kind, inner = value
        if kind in ("string", "hexstring"):
            return kind, plain(inner, o, methods["/StrF"])
        if kind == "array":
            return kind, [walk(x, o) for x in inner]
        if kind == "dictionary":
            return kind, {k: walk(x, o) for k, x in inner.items()}
        return value

    for o in file.objects:
        if o.object_id == own or o.value is None or o.compressed_in is not None or o.entries.get("/Type") == ("name", "/XRef"):
            continue
        o.value = walk(o.value, o)
        if o.stream is not None and not (_own_filter(o) or not metadata and o.entries.get("/Type") == ("name", "/Metadata")):
            o.stream = plain(o.stream, o, methods["/StmF"])


def _own_filter(o) -> bool:
    """A stream that names its own Crypt filter, the identity: it is not encrypted."""
    names, params = o.entries.get("/Filter", ("null", None)), o.entries.get("/DecodeParms", ("null", None))
    first = names if names[0] == "name" else names[1][0] if names[0] == "array" and names[1] else ("null", None)
    given = params if params[0] == "dictionary" else params[1][0] if params[0] == "array" and params[1] else ("null", None)
    name = given[1].get("/Name", ("name", "/Identity")) if given[0] == "dictionary" else ("name", "/Identity")
    return first == ("name", "/Crypt") and name == ("name", "/Identity")


def _key5(password: bytes, owner: bytes, user: bytes, entries: dict) -> bytes:
    """Revision 5: SHA-256 of the password and a salt opens the file key."""
    if hashlib.sha256(password + user[32:40]).digest() == user[:32]:
        return aes_cbc_decrypt(_bytes(entries, "/UE"), hashlib.sha256(password + user[40:48]).digest(), bytes(16), unpad=False)
    if hashlib.sha256(password + owner[32:40] + user[:48]).digest() == owner[:32]:
        return aes_cbc_decrypt(_bytes(entries, "/OE"), hashlib.sha256(password + owner[40:48] + user[:48]).digest(), bytes(16), unpad=False)
    raise PdfError("password does not fit")
