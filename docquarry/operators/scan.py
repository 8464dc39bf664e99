"""Marker scans, searches and XOR searches over any text or binary column."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.rules import BOUNDARY


def has_marker(content: Column, token: str, bounded: bool = False) -> Column:
    """A literal occurs; bounded: what follows its first occurrence is the end, a delimiter or white space."""
    at = F.instr(content, token)
    if not bounded:
        return at > 0
    after = F.substring(content, at + len(token), F.lit(1))
    return (at > 0) & ((after == "") | (F.instr(F.lit(BOUNDARY), after) > 0))


def marker_scan(df: DataFrame, rules: list[tuple[str, str, bool]], *, content: str) -> DataFrame:
    """A row per row of df and matching rule: df's columns, category, token.

    One pass over the content: the tests are columns of one projection, so rows
    that match nothing never leave it, and no join is made.
    """
    hits = F.array_compact(F.array(*[F.when(has_marker(F.col(content), t, b), F.struct(F.lit(c).alias("category"), F.lit(t.strip()).alias("token"))) for c, t, b in rules]))
    return df.withColumn("hit_", F.explode(hits)).select(*df.columns, "hit_.category", "hit_.token")


def marker_summary(found: DataFrame, *, key: str) -> DataFrame:
    """Per rule: number, least, greatest and sum of the keys that it matched."""
    return found.groupBy("category", "token").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sum(F.col(key).cast("long")).cast("long").alias("key_sum"))


def with_titles(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Titles and CVE numbers; the rule table is broadcast, some tens of rows."""
    known = rules.select("category", F.trim("token").alias("token"), "title", "cves").dropDuplicates(["category", "token"])
    return found.join(F.broadcast(known), ["category", "token"], "left")


def search(df: DataFrame, needle: str, columns: list[str], *, regex: bool = False, ignore_case: bool = False) -> DataFrame:
    """Rows in which any of the columns holds the literal, or matches the regular expression."""
    if regex:
        tests = [F.col(c).rlike(f"(?iu){needle}" if ignore_case else needle) for c in columns]
    elif ignore_case:
        tests = [F.contains(F.lower(c), F.lit(needle.lower())) for c in columns]
    else:
        tests = [F.contains(F.col(c), F.lit(needle)) for c in columns]
    return df.where(reduce(lambda a, b: a | b, tests))


def search_hex(df: DataFrame, pattern: str, *, content: str) -> DataFrame:
    """Rows whose bytes hold the pattern, written as \\x41\\x42 or 4142."""
    wanted = bytes.fromhex(pattern.replace("\\x", ""))
    return df.where(F.contains(F.col(content).cast("binary"), F.lit(wanted)))


def _differences(data: bytes) -> bytes:
    """Each byte XORed with the one before it: the same under every single-byte key."""
    a = np.frombuffer(data, np.uint8)
    return (a[1:] ^ a[:-1]).tobytes()


def _both_cases(byte: int) -> set[int]:
    return {byte, bytes([byte]).swapcase()[0]}


def _xor_finder(pattern: bytes, ignore_case: bool):
    """data to {key: first place}; differences are searched once, and a place's first byte tells the key."""
    wanted, longest = _differences(pattern), len(pattern)
    letters = [_both_cases(b) for b in pattern]
    if ignore_case:  # a change of case changes a difference, so that some places are candidates only
        classes = b"".join(b"[" + b"".join(b"\\x%02x" % d for d in sorted({x ^ y for x in a for y in b})) + b"]" for a, b in zip(letters, letters[1:], strict=False))
        candidates = re.compile(b"(?=" + classes + b")", re.S)

    def run(data: bytes) -> dict[int, int]:
        out: dict[int, int] = {}
        if len(data) < longest or not longest:
            return {} if longest else dict.fromkeys(range(256), 0)
        if longest == 1:
            values, first = np.unique(np.frombuffer(data, np.uint8), return_index=True)
            for value, place in sorted(zip(values.tolist(), first.tolist(), strict=True), key=lambda x: x[1]):
                for c in letters[0] if ignore_case else pattern:
                    out.setdefault(value ^ c, place)
            return out
        between = _differences(data)
        if not ignore_case:
            at = between.find(wanted)
            while at >= 0:
                out.setdefault(data[at] ^ pattern[0], at)
                at = between.find(wanted, at + 1)
            return out
        for m in candidates.finditer(between):
            at = m.start()
            for c in letters[0]:
                key = data[at] ^ c
                if key not in out and all(data[at + i] ^ key in letters[i] for i in range(longest)):
                    out[key] = at
        return out

    return run


def xor_search(df: DataFrame, pattern: bytes, *, key: str, content: str, ignore_case: bool = False) -> DataFrame:
    """(key column, xor_key int, offset int): each single-byte key under which the content holds the pattern, and its first place.

    Neighbouring bytes XORed with each other are the same whatever the key, so the
    differences of the content are searched once for those of the pattern: no pass
    and no copy per key, and no join with keys. An empty pattern is at place 0 of
    every content that is not empty, under all keys.
    """
    kind, find = df.schema[key].dataType, _xor_finder(pattern, ignore_case)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, keys, places = [], [], []
            for i, data in enumerate(batch.column(1).to_pylist()):
                found = find(data) if data else {}
                at += [i] * len(found)
                keys += found.keys()
                places += found.values()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(keys, pa.int32()), pa.array(places, pa.int32())], [key, "xor_key", "offset"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("xor_key", T.IntegerType()), T.StructField("offset", T.IntegerType())])
    return df.select(key, F.col(content).cast("binary").alias("content_")).mapInArrow(run, schema)


def xor_apply(df: DataFrame, xor_key: bytes, *, content: str, name: str = "xored") -> DataFrame:
    """df with the content XORed by a repeating key, as binary."""
    @F.pandas_udf("binary")
    def apply(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else xored(bytes(d), xor_key))

    return df.withColumn(name, apply(F.col(content).cast("binary")))


def xored(data: bytes, key: bytes) -> bytes:
    """Repeating-key XOR; an empty key changes nothing."""
    if not key:
        return data
    if len(key) == 1:
        return data.translate(bytes(b ^ key[0] for b in range(256)))
    a = np.frombuffer(data, np.uint8)
    return (a ^ np.resize(np.frombuffer(key, np.uint8), len(a))).tobytes() if len(a) else b""
