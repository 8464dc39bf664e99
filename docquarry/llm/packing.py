"""Best-fit packing of token sequences by large-item matching.

Lengths are whole numbers up to the capacity, so a packing is planned on the
count of pieces of each length alone: a plan of at most some thousand bin shapes,
whatever the number of documents. Pieces then take their places by their rank
among pieces of the same length, which is computed where they lie.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.tokens import END_ID, encoder

CAPACITY = 1024


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin shapes for counts[length] pieces: (number of bins, [(length, how many of it)]).

    Pieces above a third of the capacity are large: a bin holds two of them at
    most. The largest left is matched with the largest partner that fits beside
    it, all equal pairs at once. Smaller pieces, longest first, go to the fullest
    bin that takes them; where none does, to a new one.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    gaps: dict[int, list[list]] = {}  # free room -> [bins, shape]

    def put(bins: int, shape: list[tuple[int, int]]) -> None:
        free = capacity - sum(n * k for n, k in shape)
        gaps.setdefault(free, []).append([bins, shape])

    while large:
        top = large[-1]
        at = bisect.bisect_right(large, capacity - top) - 1
        if at < 0:
            put(left[top], [(top, 1)])
            large.pop()
            continue
        mate = large[at]
        if mate == top:
            pairs, single = divmod(left[top], 2)
            if pairs:
                put(pairs, [(top, 2)])
            left[top] = single
            if single:  # the last one takes the next length that there is
                if at > 0:
                    left[top] = 0
                    below = large[at - 1]
                    put(1, [(top, 1), (below, 1)])
                    left[below] -= 1
                    if not left[below]:
                        large.remove(below)
                else:
                    put(1, [(top, 1)])
            large.pop()
            continue
        pairs = min(left[top], left[mate])
        put(pairs, [(top, 1), (mate, 1)])
        left[top] -= pairs
        left[mate] -= pairs
        if not left[mate]:
            large.pop(at)
        if not left[top]:
            large.pop()
    free = sorted(gaps)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        need = left[n]
        while need:
            at = bisect.bisect_left(free, n)
            if at == len(free):
                per = min(capacity // n, need)
                bins = need // per
                _add(gaps, free, capacity - per * n, [bins, [(n, per)]])
                need -= bins * per
                continue
            room = free[at]
            bins, shape = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], free[at]
            per = min(room // n, need)
            full = min(bins, need // per)
            if bins > full:
                _add(gaps, free, room, [bins - full, shape])
            _add(gaps, free, room - per * n, [full, [*shape, (n, per)]])
            need -= full * per
    return [(bins, shape) for room in sorted(gaps) for bins, shape in gaps[room]]


def _add(gaps: dict, free: list[int], room: int, entry: list) -> None:
    if room not in gaps:
        gaps[room] = []
        bisect.insort(free, room)
    gaps[room].append(entry)


def slots(shapes: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, offset) of the plan; ranks from one row's first on lie in successive bins."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for bins, shape in shapes:
        at = 0
        for n, k in shape:
            for _ in range(k):
                out.setdefault(n, []).append((used.get(n, 0), first_bin, at))
                used[n] = used.get(n, 0) + bins
                at += n
        first_bin += bins
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def _cutter(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, END_ID).encode
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text)
                total, start, piece = len(data) // 4, 0, 0
                stop = total % capacity or min(capacity, total)  # only the first piece may be shorter
                while start < total:
                    part = data[4 * start : 4 * stop]
                    rows.append((doc_id, piece, start, stop - start, zlib.crc32(part), part if keep_ids else None))
                    start, stop, piece = stop, stop + capacity, piece + 1
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return run


def cut(docs: DataFrame, path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity tokens: doc_id, piece, start, length, ids_crc32, ids (binary, little-endian; null unless kept)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(path, capacity, keep_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")


def pack(docs: DataFrame, path: str, *, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of cut() with sequence_id long and offset long.

    path names a tokenizer file. Null and empty texts are the end id alone; a text
    of any length is encoded whole. Rows that share an id, or have none, are packed
    each for itself. An empty table gives none. Other columns of docs, of any name,
    are not looked at. The counts of parts and lengths that place the pieces grow
    with the parts, and are joined by a merge. The
    driver gets the number of pieces of each length, which is bounded by the
    capacity, and sends back the plan, which is bounded likewise.
    """
    spark = docs.sparkSession
    pieces = scratch.keep(cut(docs, path, capacity=capacity, id_col=id_col, text_col=text_col, keep_ids=keep_ids).withColumn("part", F.spark_partition_id()), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    by_part = scratch.keep(by_part, "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    placed = spark.sparkContext.broadcast(slots(plan(counts, capacity)))
    before = by_part.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    local = F.row_number().over(W.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = pieces.withColumn("local", local).join(before.hint("merge"), ["part", "length"]).withColumn("rank", (F.col("local") + F.col("before")).cast("long"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        lengths, ranks = lengths.to_numpy(), ranks.to_numpy()
        for n in np.unique(lengths):
            mine = np.flatnonzero(lengths == n)
            rows = placed.value[int(n)]
            at = np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1
            bins[mine] = rows[at, 1] + ranks[mine] - rows[at, 0]
            offsets[mine] = rows[at, 2]
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    out = ranked.withColumn("to", place("length", "rank"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "to.sequence_id", "to.offset"]
    return out.select(*columns, *(["ids"] if keep_ids else []))
