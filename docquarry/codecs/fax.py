"""Group 3 one-dimensional fax data (ITU-T T.4) to packed pixel rows, and back."""

from __future__ import annotations

from docquarry.codecs.filters import FilterError

# fixed values: codes of white and black runs of 0 to 63, of multiples of 64 up to 1728, and of 1792 to 2560 for both
_WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
""".split()
_WHITE_64 = """
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
""".split()
_BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
""".split()
_BLACK_64 = """
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
""".split()
_LONG = """
00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111
""".split()
_END_OF_LINE = "000000000001"


def _runs(short: list[str], by_64: list[str]) -> dict[int, str]:
    return dict(enumerate(short)) | {64 * (i + 1): c for i, c in enumerate([*by_64, *_LONG])}


CODES = (_runs(_WHITE, _WHITE_64), _runs(_BLACK, _BLACK_64))
_READ = tuple({c: n for n, c in codes.items()} for codes in CODES)


def fax_decode(data: bytes, columns: int = 1728, rows: int = 0, black_is_1: bool = False, k: int = 0) -> bytes:
    """Rows of packed pixels. rows 0: up to the end of the data, or six ends of line; only k = 0."""
    if k:
        raise FilterError("only one-dimensional fax data is supported", data)
    bits = "".join(f"{b:08b}" for b in data)
    at, out = 0, []

    def pack(line: list[int]) -> bytes:
        text = "".join(("1" if color == black_is_1 else "0") * n for color, n in zip([0, 1] * len(line), line, strict=False))
        return int(text.ljust((columns + 7) // 8 * 8, "0"), 2).to_bytes((columns + 7) // 8, "big") if columns else b""

    while at < len(bits) and (not rows or len(out) < rows):
        ends = 0
        while True:  # fill bits and ends of line before a row
            one = bits.find("1", at)
            if one < 0 or one - at < 11:
                break
            at, ends = one + 1, ends + 1
        if ends >= 6 or bits.find("1", at) < 0:
            break
        line, color, width = [], 0, 0
        while width < columns:
            run = 0
            while True:
                for size in range(2, 14):
                    n = _READ[color].get(bits[at : at + size])
                    if n is not None and len(bits[at : at + size]) == size:
                        break
                else:
                    if bits.find("1", at) < 0 and not line:
                        return b"".join(out)
                    raise FilterError(f"no run code at bit {at}", b"".join(out))
                at, run = at + size, run + n
                if n < 64:
                    break
            line.append(min(run, columns - width))
            width, color = width + run, 1 - color
        out.append(pack(line))
    return b"".join(out)


def fax_encode(rows: list[list[int]]) -> bytes:
    """Rows of 0 (white) and 1 (black), each after an end of line; six of them at the end."""
    bits = []
    for row in rows:
        bits.append(_END_OF_LINE)
        color, at = 0, 0
        while at < len(row):
            stop = at
            while stop < len(row) and row[stop] == color:
                stop += 1
            run = stop - at
            while run >= 64:
                step = min(2560, run // 64 * 64)
                bits.append(CODES[color][step])
                run -= step
            bits.append(CODES[color][run])
            color, at = 1 - color, stop
    text = "".join(bits) + _END_OF_LINE * 6
    return int(text.ljust((len(text) + 7) // 8 * 8, "0"), 2).to_bytes((len(text) + 7) // 8, "big")
