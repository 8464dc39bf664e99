"""Exact dedup by counting quotient filters, with byte verification.

Each input partition builds one filter over the 64-bit fingerprints of its
normalised texts: the high bits (quotient) give the place, only the low bits
(remainder) are stored, and equal fingerprints raise a counter. A filter is a
sorted list of remainders per quotient, so filters merge without loss by merging
sorted remainders, segment by segment. Fingerprints whose merged counter exceeds
one go on to the comparison of whole texts; all others are known to be single.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import scratch

#: Fingerprints that a filter takes before its segments are sent on.
FLUSH = 1 << 20
#: Fingerprints that a merged segment holds on average, at most.
SEGMENT = 1 << 16

_HEAD = struct.Struct("<QIB")


class CountingQuotientFilter:
    """Exact multiset of 64-bit fingerprints: quotient implied by place, remainder stored, counter beside it.

    runs[i] is the number of remainders under quotient base + i; remainders are
    sorted within a run, so the whole filter is in fingerprint order.
    """

    def __init__(self, q_bits: int, base: int, runs: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q_bits, self.base, self.runs, self.remainders, self.counts = q_bits, base, runs, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, q_bits: int | None = None, base: int = 0, span: int | None = None) -> CountingQuotientFilter:
        """Of fingerprints (uint64, any order, repeats counted), within span quotients from base on."""
        order = np.argsort(fingerprints, kind="stable")
        sorted_ = fingerprints[order]
        first = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))) if len(sorted_) else np.zeros(0, np.int64)
        weight = np.ones(len(sorted_), np.uint64) if counts is None else counts[order].astype(np.uint64)
        total = np.add.reduceat(weight, first) if len(first) else np.zeros(0, np.uint64)
        distinct = sorted_[first]
        if q_bits is None:
            q_bits = max(1, int(len(distinct)).bit_length())
        shift = np.uint64(64 - q_bits)
        quotients = (distinct >> shift).astype(np.int64) - base
        runs = np.bincount(quotients, minlength=span or (1 << q_bits)).astype(np.uint32)
        return cls(q_bits, base, runs, distinct & ((np.uint64(1) << shift) - np.uint64(1)), total)

    def fingerprints(self) -> np.ndarray:
        """The distinct fingerprints, ascending."""
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64) + np.uint64(self.base), self.runs)
        return (quotients << np.uint64(64 - self.q_bits)) | self.remainders

    def count(self, fingerprint: int) -> int:
        """How often a fingerprint was inserted; exact."""
        quotient, remainder = fingerprint >> (64 - self.q_bits), fingerprint & ((1 << (64 - self.q_bits)) - 1)
        if not 0 <= quotient - self.base < len(self.runs):
            return 0
        start = int(self.runs[: quotient - self.base].sum())
        stop = start + int(self.runs[quotient - self.base])
        at = start + int(np.searchsorted(self.remainders[start:stop], np.uint64(remainder)))
        return int(self.counts[at]) if at < stop and int(self.remainders[at]) == remainder else 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        """The multiset sum; lossless whatever the two quotient widths."""
        both = np.concatenate((self.fingerprints(), other.fingerprints()))
        q_bits = max(self.q_bits, other.q_bits)
        low = min(self.base << (q_bits - self.q_bits), other.base << (q_bits - other.q_bits))
        high = max((x.base + len(x.runs)) << (q_bits - x.q_bits) for x in (self, other))
        return self.build(both, np.concatenate((self.counts, other.counts)), q_bits, low, high - low)

    def to_bytes(self) -> bytes:
        """Header, runs, remainders in as many whole bytes as they need, counters."""
        width = (64 - self.q_bits + 7) // 8
        body = np.ascontiguousarray(self.remainders.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
        return _HEAD.pack(self.base, len(self.runs), self.q_bits) + self.runs.astype("<u4").tobytes() + body + self.counts.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        base, span, q_bits = _HEAD.unpack_from(data)
        at = _HEAD.size
        runs = np.frombuffer(data, "<u4", span, at)
        at += 4 * span
        n, width = int(runs.sum()), (64 - q_bits + 7) // 8
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(n, width)
        return cls(q_bits, base, runs, wide.view("<u8").reshape(n), np.frombuffer(data, "<u8", n, at + n * width))


def segments(fingerprints: np.ndarray, seg_bits: int) -> Iterator[tuple[int, CountingQuotientFilter]]:
    """A partition's filter cut at the leading seg_bits bits, empty segments left out."""
    q_bits = min(63, max(1, seg_bits, int(len(fingerprints)).bit_length()))
    whole = CountingQuotientFilter.build(fingerprints, q_bits=q_bits)
    span = 1 << (q_bits - seg_bits)
    ends = np.cumsum(whole.runs.reshape(-1, span).sum(axis=1, dtype=np.int64))
    for seg, (start, stop) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
        if stop > start:
            yield seg, CountingQuotientFilter(q_bits, seg * span, whole.runs[seg * span : (seg + 1) * span], whole.remainders[start:stop], whole.counts[start:stop])


def normalised(text):
    """Null as empty, each run of the six white-space characters as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def repeated_fingerprints(fingerprints: DataFrame, column: str = "fp") -> DataFrame:
    """(fp long, n long) of the fingerprints that occur more than once, found by merged filters."""
    rows = fingerprints.count()
    seg_bits = max(4, (max(rows, 1) // SEGMENT).bit_length())

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            cut = list(segments(np.concatenate(held), seg_bits))
            held.clear()
            return pa.RecordBatch.from_pydict({"seg": pa.array([s for s, _ in cut], pa.int32()), "filter": pa.array([f.to_bytes() for _, f in cut], pa.binary())})

        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= FLUSH:
                yield flush()
        if sum(map(len, held)):
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = [CountingQuotientFilter.from_bytes(x) for x in group["filter"]]
        while len(parts) > 1:
            parts = [a.merge(b) if b else a for a, b in zip(parts[::2], [*parts[1::2], None], strict=False)]
        more = parts[0].counts > 1
        return pd.DataFrame({"fp": parts[0].fingerprints()[more].view(np.int64), "n": parts[0].counts[more].astype(np.int64)})

    built = fingerprints.select(F.col(column).cast("long")).mapInArrow(build, "seg int, filter binary")
    return built.groupBy("seg").applyInPandas(merge, "fp long, n long")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the normalised bytes are; of equal texts the row with
    the smallest id stays (null ids last). Null and empty texts are one text.
    Rows that repeat the smallest id all count in group_size; each is kept, as
    the id is what names a row. A group of null ids only keeps a null keep_id
    and its rows. No row is dropped, other columns of docs, of any name, are not
    looked at. Texts of any length are compared whole. An empty table gives no rows.

    Hot groups: fingerprints are counted inside each partition, copies are
    reduced to one text per partition before any shuffle, and only slim rows
    (id, digests) join on a group's key.
    """
    text = normalised(F.col(f"`{text_col}`").cast("string"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("t"))
    slim = scratch.keep(rows.select("doc_id", F.xxhash64("t").alias("fp"), F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha")), "digests")
    repeated = scratch.keep(repeated_fingerprints(slim).select("fp"), "repeated")
    # bytes are compared here: the text itself is the key, reduced to one row per partition first
    suspects = rows.withColumn("fp", F.xxhash64("t")).join(repeated, "fp", "left_semi")
    groups = suspects.groupBy("fp", "t").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = scratch.keep(groups.select("fp", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("sha"), "keep_id", "group_size"), "groups")
    out = slim.join(groups, ["fp", "sha"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
