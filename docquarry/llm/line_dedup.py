"""Line dedup by overlapping windows of three lines.

A line ends at a line feed, or, unless whole lines are asked for, at the spaces
after a sentence's end: so that a passage is found on however many lines it
lies, and where its first or last sentence shares a line with other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.text import as_row

WINDOW = 3
#: What an escaped text has where a line ends, what stands for the escape character, and that character.
_CUT, _SELF, _ESCAPE = "\x1f1", "\x1f0", "\x1f"


def _lines(text: Column, sentences: bool) -> Column:
    """The lines, each with what ends it: joined they are the text."""
    escaped = F.replace(F.coalesce(text, F.lit("")), F.lit(_ESCAPE), F.lit(_SELF))
    marked = F.regexp_replace(escaped, r"(\n|[.!?] +)" if sentences else r"(\n)", "$1" + _CUT)
    return F.split(marked, _CUT)


def _text(lines: Column) -> Column:
    return F.replace(F.array_join(lines, ""), F.lit(_SELF), F.lit(_ESCAPE))


def _windows(keys: Column, width: int) -> Column:
    """Two 64-bit hashes, of different seeds, of each run of width keys; none for shorter texts."""
    starts = F.sequence(F.lit(0), F.size(keys) - width)
    joined = F.transform(starts, lambda i: F.array_join(F.slice(keys, i + 1, width), "\n"))
    hashed = F.transform(joined, lambda w: F.struct(F.xxhash64(w).alias("h1"), F.xxhash64(F.lit(1), w).alias("h2")))
    return F.when(F.size(keys) >= width, hashed).otherwise(F.array().cast("array<struct<h1: bigint, h2: bigint>>"))


def _place(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two numbers that name a row by its id and text and order rows, null ids last: the id, and 60 bits of the md5."""
    digest = F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    return F.coalesce(doc_id, F.lit((1 << 63) - 1)), F.when(doc_id.isNull(), digest + F.lit(1 << 60)).otherwise(digest)


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, sentences: bool = True) -> DataFrame:
    """(id, digest, at int, first boolean) of each window that occurs more than once in the table; id and digest as _place() has them.

    first marks the occurrence with the smallest (id, digest, line). One hash of
    each window is counted within each partition before the shuffle; windows whose
    hash repeats then meet by both hashes. The slim rows of a frequent window are
    dealt by AQE's skew join.
    """
    text, doc_id = F.col(f"`{text_col}`").cast("string"), F.col(f"`{id_col}`").cast("long")
    number, digest = _place(doc_id, text)
    rows = docs.select(number.alias("id"), digest.alias("digest"), F.transform(_lines(text, sentences), lambda x: F.trim(x, F.lit(" \n"))).alias("keys"))
    found = rows.select("id", "digest", F.posexplode(_windows(F.col("keys"), width)).alias("at", "h")).select("id", "digest", "at", "h.h1", "h.h2")
    found = scratch.keep(found, "windows", compression="zstd")
    # counts are written before they are joined: a join whose sides are both dealt anew can split a frequent window
    often = scratch.keep(found.groupBy("h1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1"), "often")
    some = scratch.keep(found.join(often, "h1", "left_semi"), "repeated")
    scratch.drop(found)
    # rows equal in id and text are one place, and the first one if it is theirs
    first = some.groupBy("h1", "h2").agg(F.min(F.struct("id", "digest", "at")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = scratch.keep(first, "first")
    return some.join(first, ["h1", "h2"]).select("id", "digest", "at", ((F.col("id") == F.col("f.id")) & (F.col("digest") == F.col("f.digest")) & (F.col("at") == F.col("f.at"))).alias("first"))


def line_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, sentences: bool = True) -> DataFrame:
    """(row struct, text, n_lines int, removed_lines array<int>): a row per row of docs, as it was, its rewritten text and the 0-based lines that went.

    A line goes if it lies in a window of width consecutive lines that occurred
    before, in a document with a smaller id or earlier in the same one; covered
    positions of overlapping windows merge. Lines end at line feeds and, with
    sentences, at the spaces after ".", "!" or "?"; empty ones are lines too.
    Spaces and line feeds around a line do not count in comparisons. Texts of
    fewer lines than a window are unchanged, null ones stay null and have one
    line, an empty table gives none, and a text of any length takes time in
    proportion to it. Null ids come last. Rows that share an id are ordered by the
    md5 of their texts; rows equal in id and text count as one place, and keep or
    lose the same lines. Columns of docs of any name are allowed, as row holds
    them. Texts are shuffled once, to meet their removals.
    """
    gone = repeated_windows(docs, id_col=id_col, text_col=text_col, width=width, sentences=sentences).where(~F.col("first"))
    # bounded by the document's own lines
    by_text = gone.groupBy("id", "digest").agg(F.collect_set("at").alias("starts"))
    number, digest = _place(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    joined = docs.select(as_row(docs).alias("row"), number.alias("id"), digest.alias("digest")).join(by_text, ["id", "digest"], "left")
    text = F.col("row").getField(text_col).cast("string")
    cut = joined.select("row", _lines(text, sentences).alias("lines"), F.sort_array(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (width - 1)))))).alias("removed"))
    # lines twice, else it would be computed anew inside the function
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = _text(F.transform(places, lambda i: F.get(F.col("lines"), i)))
    new = F.when(F.col("removed").isNull(), text).otherwise(kept)
    return cut.select("row", new.alias("text"), F.size("lines").alias("n_lines"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed_lines"))
