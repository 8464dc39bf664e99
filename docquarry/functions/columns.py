"""Column builders: text measures, number and byte conversions, script detection. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what a script detector counts, and its limits
SCRIPT_STRINGS = (
    "var ", ";", ")", "(", "function ", "=", "{", "}", "if(", "if (", "if ", "else {", "else{", "else if", "return",
    "while(", "while (", "while ", "for(", "for (", "for ", ",", "eval",
)
SCRIPT_KEYS = (";", "(", ")")
MANY_STRINGS, DISTINCT_STRINGS, SHORT_SCRIPT, DENSE_PERCENT = 15, 5, 100, 10


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / F.lit(len(literal))).cast("long")


def nonprintable_count(text: Column) -> Column:
    """Characters outside space to tilde."""
    return F.length(F.regexp_replace(text, r"[\x20-\x7e]", "")).cast("long")


def escape_regex(text: Column) -> Column:
    """A backslash before each of the twelve metacharacters."""
    return F.regexp_replace(text, r"([\\.*?+^$(){}\[\]|])", r"\\$1")


def bits_of(number: Column, width: int) -> Column:
    """Binary text of the low width bits."""
    return F.right(F.lpad(F.bin(number), 64, "0"), F.lit(width))


def bytes_of_bits(bits: Column) -> Column:
    """Binary text, whole bytes from the left; a rest is dropped."""
    pieces = F.regexp_extract_all(bits, F.lit("([01]{8})"), F.lit(1))
    return F.unhex(F.array_join(F.transform(pieces, lambda x: F.lpad(F.conv(x, 2, 16), 2, "0")), ""))


def numbers_of_bytes(data: Column, width: int) -> Column:
    """Fixed-width unsigned numbers, high bit first; a rest is dropped. width at most 63."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))
    bits = F.array_join(F.transform(pairs, lambda x: F.lpad(F.conv(x, 16, 2), 8, "0")), "")
    return F.transform(F.regexp_extract_all(bits, F.lit(f"(.{{{width}}})"), F.lit(1)), lambda x: F.conv(x, 2, 10).cast("long"))


def hex_to_bytes(text: Column) -> Column:
    """An odd digit is padded on the left."""
    return F.unhex(F.when(F.length(text) % 2 == 1, F.concat(F.lit("0"), text)).otherwise(text))


def hex_string_to_bytes(text: Column) -> Column:
    """A hexadecimal string object: white space dropped, an odd digit padded on the right."""
    digits = F.regexp_replace(text, r"[\x00\t\n\f\r ]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


def number_to_bytes(number: Column, width: int) -> Column:
    """Big-endian bytes; null where it needs more than width."""
    digits = F.hex(number)
    return F.when(F.length(digits) <= 2 * width, F.unhex(F.lpad(digits, 2 * width, "0")))


def number_to_text(number: Column, width: int) -> Column:
    """Decimal, zero-padded; null where it needs more than width."""
    digits = number.cast("string")
    return F.when(F.length(digits) <= width, F.lpad(digits, width, "0"))


def references_in(text: Column) -> Column:
    """array<string> of the references "id gen R" in a text."""
    return F.regexp_extract_all(text, F.lit(r"(\d{1,5}[\x09-\x0D\x20]{1,3}\d{1,5}[\x09-\x0D\x20]{1,3}R)"), F.lit(1))


def reference_id(reference: Column) -> Column:
    return F.regexp_extract(reference, r"^(\d+)", 1).cast("int")


def base64_text(data: Column) -> Column:
    """Base64 on one line."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def digests(data: Column) -> list[Column]:
    """md5, sha1 and sha256 of bytes."""
    return [F.md5(data).alias("md5"), F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256")]


def byte_range(data: Column, offset: int, size: int) -> Column:
    """size bytes from a 0-based offset, clamped at the end."""
    return F.substring(data, offset + 1, size)


def hexdump_row(data: Column, row: int = 0) -> Column:
    """Sixteen bytes as hex pairs, then their printable characters, dots for others."""
    part = F.substring(data, 16 * row + 1, 16)
    pairs = F.trim(F.regexp_replace(F.lower(F.hex(part)), "(..)", "$1 "))
    gutter = F.regexp_replace(F.decode(part, "ISO-8859-1"), r"[^\x20-\x7e]", ".")
    return F.concat(F.rpad(pairs, 47, " "), F.lit("  |"), gutter, F.lit("|"))


def hexdump(data: Column) -> Column:
    """array<string>: every row of sixteen bytes; one empty row for no bytes."""
    hexed, plain = F.lower(F.hex(data)), F.decode(data, "ISO-8859-1")
    # both as arrays of rows first: a row is then found without walking the text
    pairs = F.split(F.regexp_replace(hexed, "(.{32})(?=.)", "$1\n"), "\n")
    signs = F.split(F.regexp_replace(F.regexp_replace(plain, r"[^\x20-\x7e]", "."), "(.{16})(?=.)", "$1\n"), "\n")
    return F.zip_with(pairs, signs, lambda p, s: F.concat(F.rpad(F.trim(F.regexp_replace(p, "(..)", "$1 ")), 47, " "), F.lit("  |"), s, F.lit("|")))


def joined_quotes(text: Column) -> Column:
    """The bodies of all quoted fragments, joined."""
    return F.array_join(F.regexp_extract_all(text, F.lit("[\"'](.*?)[\"']"), F.lit(1)), "")


def scripts_in(text: Column) -> Column:
    """array<string> of the bodies of script elements."""
    return F.regexp_extract_all(text, F.lit(r"(?is)<script[^>]*?>(.*?)</script>"), F.lit(1))


def script_score(text: Column) -> Column:
    """All occurrences of what a script detector counts."""
    total = F.lit(0).cast("long")
    for s in SCRIPT_STRINGS:
        total = total + occurrences(text, s)
    return total


def is_javascript(text: Column) -> Column:
    """Script element: yes. Control characters or bytes from 127 on: no. Else all three key signs, and many strings of five kinds, or a short and dense text."""
    counts = [occurrences(text, s) for s in SCRIPT_STRINGS]
    total, kinds = counts[0], F.when(counts[0] > 0, 1).otherwise(0)
    for c in counts[1:]:
        total, kinds = total + c, kinds + F.when(c > 0, 1).otherwise(0)
    odd = F.regexp_count(text, F.lit(r"[^\x00\x09\x0a\x0c\x0d\x20-\x7e]")) > 0
    keys, word = F.lit(True), F.lit(False)
    for s, c in zip(SCRIPT_STRINGS, counts, strict=True):
        if s in SCRIPT_KEYS:
            keys = keys & (c > 0)
        if any(x.isalnum() for x in s):
            word = word | (c > 0)
    dense = (F.length(text) > 0) & (F.length(text) < SHORT_SCRIPT) & (total * F.lit(100.0) > F.length(text) * F.lit(float(DENSE_PERCENT)))
    element = F.regexp_count(text, F.lit(r"(?is)<script[^>]*?contentType[^>]*?x-javascript[^>]*?>(.*?)</script>")) > 0
    return F.coalesce(element | (~odd & keys & word & (((total > MANY_STRINGS) & (kinds >= DISTINCT_STRINGS)) | dense)), F.lit(False))


def sing_font(data: Column) -> Column:
    """A SING table whose unique name runs over: over 327 bytes, the tag at 236, byte 327 not zero."""
    return F.coalesce((F.octet_length(data) > 327) & (F.hex(F.substring(data, 237, 4)) == "53494E47") & (F.hex(F.substring(data, 328, 1)) != "00"), F.lit(False))


def font_program(data: Column) -> Column:
    """Begins as a TrueType or OpenType font, or a collection of them, does; tables such as SING lie in nothing else."""
    return F.coalesce(F.hex(F.substring(data, 1, 4)).isin("00010000", "4F54544F", "74727565", "74746366"), F.lit(False))


def bmp_rle(text: Column, token: str, more_than: int) -> Column:
    return F.coalesce(occurrences(text, token) > more_than, F.lit(False))
