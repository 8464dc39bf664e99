"""Small pieces that the operators share: word pattern, hashes of ids, Arrow access."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words in a text, null counting as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_digest(text: Column) -> Column:
    """md5 (16 bytes) of a text, null as empty: with the id it names a row."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def as_row(docs: DataFrame) -> Column:
    """All columns as one struct, so that what an operator adds clashes with none."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns])


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; -1 where the id is null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus), F.lit(-1)).cast("int")


def raw(batch: pa.RecordBatch, name: str) -> list:
    """A text column as UTF-8 bytes objects, null as None."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()
