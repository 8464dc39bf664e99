"""Codecs and escapes: published examples, and what is encoded comes back."""

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docquarry.codecs import escapes, filters

REVERSIBLE = ["FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode", "LZWDecode", "Crypt"]


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.lists(st.sampled_from(REVERSIBLE), max_size=3))
def test_chain_comes_back(data, names):
    assert filters.decode(filters.encode(data, names), names) == (data, None)


def test_lzw_goes_through_every_width():
    data = bytes(range(256)) * 200 + zlib.compress(bytes(range(256)) * 50) * 20
    assert filters.lzw_decode(filters.lzw_encode(data)) == data


def test_flate_example():
    data = bytes.fromhex("789c4b2c28d04bcc492d2ad150f248cdc9c95708cf2fca49515454d231d6b406009669 0915")
    text = b'app.alert("Hello World!!",3);'
    assert filters.decode(data, ["Fl"]) == (text, None) and filters.decode(filters.encode(text, ["Fl"]), ["Fl"]) == (text, None)


def test_truncated_flate_keeps_what_came_out():
    data = zlib.compress(bytes(100_000))
    out, error = filters.decode(data[: len(data) // 2], ["FlateDecode"])
    assert error and out and set(out) == {0}


def test_output_is_limited():
    with pytest.raises(filters.FilterError) as e:
        filters.flate_decode(zlib.compress(bytes(1 << 22)), limit=1000)
    assert len(e.value.partial) == 1000


def test_odd_hex_digit_is_a_high_half():
    assert filters.ascii_hex_decode(b"41 4>") == b"A@"


def test_row_predictors():
    rows = [bytes([1, 2, 3, 4]), bytes([5, 6, 7, 8])]
    assert filters.unpredict(b"\x00" + rows[0] + b"\x02" + bytes(b - a for a, b in zip(*rows, strict=True)), 12, 4) == b"".join(rows)
    assert filters.unpredict(bytes([1, 1, 1, 1]), 2, 4) == bytes([1, 2, 3, 4])


def test_escapes():
    assert escapes.unescape_js("%u6554%u7473") == b"Test"
    assert escapes.unescape_js("%41%42", wide=False) == b"AB"
    assert escapes.decode_name("/J#61va") == "/Java"
    assert escapes.decode_octal("\\101\\7") == "A\x07"
    assert escapes.unescape_string(r"a\(b\)\n\\\053") == "a(b)\n\\+"
    assert escapes.unescape_entities("&amp;&#65;&nothing;") == "&A&nothing;"


@given(st.text(st.characters(max_codepoint=255), max_size=50))
def test_string_escapes_come_back(text):
    assert escapes.unescape_string(escapes.escape_string(text)) == text
    assert escapes.decode_name(escapes.encode_name(text)) == text or "/" in text
    assert escapes.decode_octal(escapes.encode_octal(text)) == text


def test_unescape_calls_follow_variables():
    script = 'var a = "%u4141"; b = unescape(a + "' + "%u4242" * 40 + '");'
    (data, urls), *rest = escapes.unescape_calls(script)
    assert not rest and data.startswith(b"AABB") and not urls


def test_variables_that_refer_to_themselves_end():
    assert escapes.variable_content("a = b + 'x'; b = a;", "a").strip("x") == ""


def test_fax_codes_are_prefix_free():
    from docquarry.codecs import fax

    for codes in fax.CODES:
        every = sorted([*codes.values(), fax._END_OF_LINE])
        assert len(every) == 64 + 27 + 13 + 1
        assert not any(b.startswith(a) for a, b in zip(every, every[1:], strict=False))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(1, 400), min_size=1, max_size=12), max_size=6), st.booleans())
def test_fax_rows_come_back(runs, black_is_1):
    from docquarry.codecs import fax

    rows = [[(i % 2) for i, n in enumerate(r) for _ in range(n)] for r in runs]
    width = max(map(len, rows), default=8)
    rows = [r + [0] * (width - len(r)) for r in rows]
    out = filters.decode_one(fax.fax_encode(rows), "CCF", {"Columns": width, "BlackIs1": black_is_1})
    size = (width + 7) // 8
    got = [[int(b) for byte in out[i * size : (i + 1) * size] for b in f"{byte:08b}"][:width] for i in range(len(rows))]
    assert got == [[v if black_is_1 else 1 - v for v in r] for r in rows] and len(out) == size * len(rows)


def jj_encode(text, name="$"):
    """What such encoders write: letters by members, other characters by octal or Unicode escapes made of digits."""
    from docquarry.codecs import jj

    digit = {f"{i:x}": f"{name}.{m}" for i, m in enumerate(jj._DIGITS)}
    known = {v: f"{name}.{k}" for k, v in jj._LETTERS.items()} | {"l": f'(![]+"")[{name}._$_]'} | {c: digit[c] for c in "abcdef"}
    parts = []
    for ch in text:
        if ch in known:
            parts.append(known[ch])
        elif ord(ch) < 128:
            parts.append('"\\\\"+' + "+".join(digit[d] for d in f"{ord(ch):03o}"))
        else:
            parts.append('"\\\\"+' + known["u"] + "+" + "+".join(digit[d] for d in f"{ord(ch):04x}"))
    return f'{name}=~[];{name}={{___:++{name},$$$$:(![]+"")[{name}]}};{name}.$({name}.$({name}.$$+"\\""+' + "".join(p + "+" for p in parts) + '"\\"")())();'


@settings(max_examples=60, deadline=None)
@given(st.text(st.characters(max_codepoint=0xFFFF, exclude_categories=("Cs",)), max_size=40), st.sampled_from(["$", "_a"]))
def test_jj_comes_back(text, name):
    from docquarry.codecs.jj import jj_decode

    assert jj_decode("x=1;" + jj_encode(text, name)) == text
    assert jj_decode(text) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="/#\\\\07aAé\u012f\U0001f600 \n", max_size=200), st.integers(0, 60))
def test_escapes_by_arrays_are_those_by_characters(text, more):
    import re

    for t in (text, text + "\\377\\456" * more, "#41#fF" * more + "/" + text):
        assert escapes.encode_octal(t) == "".join(f"\\{ord(c) & 255:03o}" for c in t)
        assert escapes.encode_name(t) == "".join(c if c == "/" else f"#{ord(c) & 255:02x}" for c in t)
        for x in (t, escapes.encode_octal(t), escapes.encode_name(t)):
            assert escapes.decode_octal(x) == re.sub(r"\\([0-7]{1,3})", lambda m: chr(int(m[1], 8) & 255), x)
            assert escapes.decode_name(x) == re.sub("#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), x)
        assert escapes.unescape_string(escapes.escape_string(t)) == t


def test_python_holds_slices_of_large_batches():
    import pyarrow as pa

    from docquarry.session import SLICE, SLICE_BYTES, slices

    texts = ["x" * 100] * 5000 + ["y" * 1_000_000] * 9 + ["z" * (SLICE_BYTES + 1), None]
    parts = list(slices([pa.record_batch([pa.array(texts)], ["t"]), pa.record_batch([pa.array([], pa.string())], ["t"])]))
    assert [t for p in parts for t in p.column(0).to_pylist()] == texts
    assert all(p.num_rows <= SLICE and (p.nbytes <= SLICE_BYTES or p.num_rows == 1) for p in parts)


def test_mapped_texts(spark):
    df = spark.createDataFrame([(1, "a/é"), (2, None), (3, "")], "id long, t string")
    found = escapes.mapped(df, ["id"], up=("t", [str.upper]), twice=("t", [escapes.encode_name, escapes.decode_name]))
    assert sorted(tuple(r) for r in found.collect()) == [(1, "A/É", "a/é"), (2, None, None), (3, "", "")]
