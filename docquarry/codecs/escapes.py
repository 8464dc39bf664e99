"""Escapes of names, strings, scripts and markup: pure functions, and columns over them."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from html.entities import html5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from docquarry.session import slices

_ENTITY = re.compile(r"&#?\w+;")
_NAME = re.compile(r"#([0-9A-Fa-f]{2})")
_OCTAL = re.compile(r"\\([0-7]{1,3})")
_UNICODE = re.compile(r"[%\\]u([0-9A-Fa-f]{4})|%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})", re.I)
_STRING = re.compile(r"\\([nrtbf()\\]|[0-7]{1,3}|\r\n|\r|\n|.)", re.S)

# fixed values: letters after a backslash in a literal string
_LETTERS = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}
_BACK = str.maketrans({v: "\\" + k for k, v in _LETTERS.items()} | {c: "\\" + c for c in "()\\"})


# what stands for each byte in an octal code, and in a name; values of octal and hexadecimal digits
_OCTALS, _HASHES = np.array([b"\\%03o" % i for i in range(256)]), np.array([b"#%02x" % i for i in range(256)])
_DIGITS = np.full((2, 256), 255, np.uint8)
for _row, _digits in enumerate(("01234567", "0123456789abcdefABCDEF")):
    for _digit in _digits:
        _DIGITS[_row, ord(_digit)] = int(_digit, 16)
#: Characters from which arrays are tried.
_LONG = 64


def _low_bytes(text: str) -> np.ndarray:
    """The last eight bits of each character's number."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint8)[::4]


def _whole_codes(text: str, mark: bytes, base: int) -> str | None:
    """A text of nothing but a mark and a byte's digits, over and over, decoded; None if it is anything else."""
    width = 1 + (3 if base == 8 else 2)
    if len(text) < _LONG or len(text) % width or not text.isascii():
        return None
    codes = np.frombuffer(text.encode(), np.uint8).reshape(-1, width)
    digits = _DIGITS[int(base == 16)].take(codes[:, 1:])
    if (codes[:, 0] != mark[0]).any() or (digits == 255).any():
        return None
    value = digits[:, 0]
    for k in range(1, width - 1):
        value = value * np.uint8(base) + digits[:, k]  # bits beyond eight go
    return value.tobytes().decode("latin-1")


def decode_name(name: str) -> str:
    """#xx to its character."""
    if "#" not in name:
        return name
    if len(name) < _LONG:
        return _NAME.sub(lambda m: chr(int(m[1], 16)), name)
    parts = []
    for part in name.split("/"):
        whole = _whole_codes(part, b"#", 16)
        parts.append(_NAME.sub(lambda m: chr(int(m[1], 16)), part) if whole is None else whole)
    return "/".join(parts)


def encode_name(name: str) -> str:
    """Every character but the slash as #xx."""
    return "/".join(_HASHES.take(_low_bytes(part)).tobytes().decode() for part in name.split("/"))


def decode_octal(text: str) -> str:
    whole = _whole_codes(text, b"\\", 8)
    return _OCTAL.sub(lambda m: chr(int(m[1], 8) & 255), text) if whole is None else whole


def encode_octal(text: str) -> str:
    return _OCTALS.take(_low_bytes(text)).tobytes().decode()


def unescape_string(text: str) -> str:
    """A literal string's escapes: letters, brackets, octal codes; a line break after a backslash goes, any other backslash too."""
    def one(m: re.Match) -> str:
        s = m[1]
        if s in _LETTERS:
            return _LETTERS[s]
        if s[0] in "01234567":
            return chr(int(s, 8) & 255)
        return "" if s[0] in "\r\n" else s

    return _STRING.sub(one, text)


def escape_string(text: str) -> str:
    return text.translate(_BACK)


def unescape_js(text: str, wide: bool = True) -> bytes:
    """%uABCD and \\uABCD to CD AB; %XX and \\xXX to the byte, with a zero after it in wide text; other characters likewise."""
    out, at = bytearray(), 0
    pad = b"\x00" if wide and re.search(r"[%\\]u[0-9A-Fa-f]{4}", text, re.I) else b""
    for m in _UNICODE.finditer(text):
        for c in text[at : m.start()]:
            out += c.encode("latin-1", "replace") + pad
        if m[1]:
            out += int(m[1], 16).to_bytes(2, "little")
        else:
            out += bytes([int(m[2] or m[3], 16)]) + pad
        at = m.end()
    for c in text[at:]:
        out += c.encode("latin-1", "replace") + pad
    return bytes(out)


def unescape_entities(text: str) -> str:
    """Numeric and named entities that end in a semicolon; unknown ones stay."""
    return _ENTITY.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), text)


def variable_content(script: str, expression: str, depth: int = 20) -> str:
    """The text of an expression of quoted parts and variables joined by +, variables taken from their last assignment; cycles end."""
    out = []
    for part in re.findall(r"\"[^\"]*\"|'[^']*'|[^+]+", expression):
        part = part.strip()
        if part[:1] in "\"'":
            out.append(part[1:-1])
        elif part and depth and re.fullmatch(r"[A-Za-z_$][\w$]*", part):
            found = re.findall(rf"(?<![\w$.]){re.escape(part)}\s*=\s*([^;=][^;]*)", script)
            if found:
                out.append(variable_content(script, found[-1], depth - 1))
    return "".join(out)


def unescape_calls(script: str, at_least: int = 150) -> list[tuple[bytes, list[str]]]:
    """Bytes of each unescape() call with a long enough content, and the addresses in them."""
    out = []
    for expression in re.findall(r"unescape\s*\(([^)]*)\)", script):
        content = variable_content(script, expression)
        if len(content) > at_least:
            data = unescape_js(content)
            narrow = data.replace(b"\x00", b"").decode("latin-1")
            out.append((data, re.findall(r"https?://[\x21-\x7e]*", narrow)))
    return out


def calls_of(script: str, function: str) -> list[str]:
    """Arguments of each call of a function, by its name or by a variable that it, or another such variable, was given to; cycles end."""
    names, open_ = {function}, [function]
    while open_:
        name = open_.pop()
        for alias in re.findall(rf"([A-Za-z_$][\w$]*)\s*=\s*{re.escape(name)}\s*(?:;|$)", script):
            if alias not in names:
                names.add(alias)
                open_.append(alias)
    either = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return [m[1] for m in re.finditer(rf"(?<![\w$.])(?:{either})\s*\(([^)]*)\)?", script)]


def mapped(df: DataFrame, keep: list[str], **texts: tuple[str, list[Callable[[str], str]]]) -> DataFrame:
    """Columns of df, and texts (column, functions): what the functions, one after the other, make of the column.

    Python holds a slice of a batch and what becomes of it at a time, not a batch
    in each of its forms, as functions of columns do.
    """
    names = list(dict.fromkeys([*keep, *[column for column, _ in texts.values()]]))
    inputs = df.select(*names)
    schema = StructType([*[inputs.schema[k] for k in keep], *[StructField(name, StringType()) for name in texts]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            arrays = [part.column(names.index(k)) for k in keep]
            for column, functions in texts.values():
                made = []
                for text in part.column(names.index(column)).to_pylist():
                    for f in functions if text is not None else ():
                        text = f(text)
                    made.append(text)
                arrays.append(pa.array(made, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *texts])

    return inputs.mapInArrow(run, schema)


def _text_udf(function):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else function(x))

    return run


def decode_name_col(c: Column) -> Column:
    return _text_udf(decode_name)(c)


def decode_octal_col(c: Column) -> Column:
    return _text_udf(decode_octal)(c)


def unescape_string_col(c: Column) -> Column:
    return _text_udf(unescape_string)(c)


def unescape_entities_col(c: Column) -> Column:
    return _text_udf(unescape_entities)(c)


def unescape_js_col(c: Column) -> Column:
    @F.pandas_udf("binary")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unescape_js(x))

    return run(c)


def encode_name_col(c: Column) -> Column:
    return _text_udf(encode_name)(c)


def encode_octal_col(c: Column) -> Column:
    return _text_udf(encode_octal)(c)


def escape_string_col(c: Column) -> Column:
    return _text_udf(escape_string)(c)


def variable_content_col(script: Column, expression: str) -> Column:
    return _text_udf(lambda s: variable_content(s, expression))(script)


def calls_col(script: Column, function: str) -> Column:
    """array<string> of the arguments of each call."""
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else calls_of(x, function))

    return run(script)
