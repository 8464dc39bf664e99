"""Token ids in bit-packed binary files.

A file is a run of blocks, in document order. A block holds up to BLOCK_IDS ids
of whole documents (more only for one long document) and reads alone:

    magic 4s | bits u8 | flags u8 | bucket u32 | block u32 | n_docs u32 | n_ids u64
    doc ids i64[n_docs] | null flags u8[n_docs] | ends u64[n_docs] | ids, bits each, high bit first, padded to a byte

ends are running counts of ids, so a document is at bits * ends[i-1] of the body.
Records end with a line feed. A file's last record is the index of its blocks:

    magic 4s | n_blocks u32 | per block: offset u64, bucket u32, block u32, n_docs u32, n_ids u64 | its own length u32 | magic 4s

so that a reader goes from the end of the file to any block. The files of a table
are written by Spark's own writer, and read by its binary reader, so any store
that Spark reaches will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.tokens import END_ID, encoder

MAGIC, INDEX = b"TKB1", b"TKBX"
BLOCK_IDS = 1 << 18
#: Text bytes for each range of ids, about, and ranges at most; a task writes a range, in as many files as it takes.
RANGE_BYTES, RANGES = 24 << 20, 20_000
#: Records of a file at most, its index included: some 16 MB of ids.
RECORDS = 33
#: Documents that a worker encodes before it hands their ids on.
SLICE = 256
_HEAD, _ENTRY = struct.Struct("<4sBBIIIQ"), struct.Struct("<QIIIQ")


def bits_for(vocabulary: int) -> int:
    """The least bits that hold every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids of fixed width, high bit first, padded with zeros to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - bits :]
    return np.packbits(wide.reshape(-1)).tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """count ids from the start-th on, as uint32, reading only the bytes that hold them."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first = start * bits
    last = first + count * bits
    flat = np.unpackbits(np.frombuffer(data, np.uint8, (last + 7) // 8 - first // 8, first // 8))[first % 8 : first % 8 + count * bits]
    wide = np.zeros((count, 32), np.uint8)
    wide[:, 32 - bits :] = flat.reshape(count, bits)
    return np.packbits(wide, axis=1).view(">u4").reshape(count).astype(np.uint32)


def write_block(bucket: int, number: int, doc_ids: list, ids: list[np.ndarray], bits: int) -> bytes:
    ends = np.cumsum([len(x) for x in ids], dtype=np.uint64)
    body = pack_bits(np.concatenate(ids) if ids else np.zeros(0, np.uint32), bits)
    head = _HEAD.pack(MAGIC, bits, 0, bucket, number, len(ids), int(ends[-1]) if len(ids) else 0)
    named = np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes()
    return head + named + bytes(i is None for i in doc_ids) + ends.astype("<u8").tobytes() + body


class Block:
    """A view of a block in a file's bytes; ids are unpacked when asked for."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        magic, self.bits, _, self.bucket, self.number, self.n_docs, self.n_ids = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += _HEAD.size
        n = self.n_docs
        self.doc_ids = np.frombuffer(data, "<i8", n, at)
        self.no_id = np.frombuffer(data, np.uint8, n, at + 8 * n).astype(bool)
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        at += 17 * n
        self.end = at + (self.n_ids * self.bits + 7) // 8
        self.body = memoryview(data)[at : self.end]

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document of the block."""
        start = int(self.ends[i - 1]) if i else 0
        return unpack_bits(self.body, self.bits, start, int(self.ends[i]) - start)

    def ids(self) -> np.ndarray:
        return unpack_bits(self.body, self.bits, 0, self.n_ids)


def write_index(entries: list[tuple[int, int, int, int, int]]) -> bytes:
    """The last record of a file, for blocks (offset, bucket, block, n_docs, n_ids)."""
    body = INDEX + struct.pack("<I", len(entries)) + b"".join(_ENTRY.pack(*e) for e in entries)
    return body + struct.pack("<I", len(body) + 8) + INDEX


def read_index(data: bytes | memoryview) -> list[tuple[int, int, int, int, int]]:
    """(offset, bucket, block, n_docs, n_ids) of the blocks of a whole file, or of its end if that holds the index."""
    end = len(data) - 1  # the line feed
    length, magic = struct.unpack_from("<I4s", data, end - 8)
    if magic != INDEX:
        raise ValueError("no index at the end of the file")
    n = struct.unpack_from("<I", data, end - length + 4)[0]
    return [_ENTRY.unpack_from(data, end - length + 8 + i * _ENTRY.size) for i in range(n)]


def blocks(data: bytes) -> Iterator[Block]:
    """All blocks of a file, by its index."""
    for offset, *_ in read_index(data) if data else ():
        yield Block(data, offset)


class _Ranges:
    """Which range a row goes to: ranges of ids, an id that fills several dealt over them by a hash of its text, and so null ids, in ranges of their own."""

    def __init__(self, cuts: list[int], without_id: int):
        self.cuts, self.without_id = np.array(sorted(cuts), np.int64), max(1, without_id)
        self.n = len(self.cuts) + 1 + self.without_id

    def of(self, doc_id: int | None, spread: int) -> int:
        u = (spread + (1 << 63)) / 2.0**64
        if doc_id is None:
            return len(self.cuts) + 1 + min(int(u * self.without_id), self.without_id - 1)
        low, high = (int(np.searchsorted(self.cuts, doc_id, side=x)) for x in ("left", "right"))
        return high if high - low < 2 else low + 1 + min(int(u * (high - low)), high - low - 1)


def _encode(path: str, ranges: _Ranges):
    """Ids of each text, and its range."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, END_ID).encode
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                wide = [np.frombuffer(encode(t), "<u4") for t in batch.column(1).to_pylist()]
                slim = [x.astype("<u2").tobytes() if len(x) and x.max() < 1 << 16 else x.tobytes() for x in wide]
                bucket = list(map(ranges.of, batch.column(0).to_pylist(), batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([len(x) for x in wide], pa.int64()), pa.array(slim, pa.binary()), pa.array(bucket, pa.int32())], ["doc_id", "spread", "n", "ids", "bucket"])

    return run


def _packer(bits: int, records: int):
    """Blocks in order, and after each records - 1 of them, and at the end, the index of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, names, held, size, at = None, 0, [], [], 0, 0
        entries: list[tuple[int, int, int, int, int]] = []

        def record(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal at, number, size
            data = write_block(bucket, number, names, held, bits)
            entries.append((at, bucket, number, len(names), size))
            at, number, size = at + len(data) + 1, number + 1, 0
            names.clear()
            held.clear()
            yield record(data)
            if len(entries) == records - 1:
                yield from close()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal at
            if entries:
                yield record(write_index(entries))
            entries.clear()
            at = 0

        for batch in batches:
            for doc_id, n, ids, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (b != bucket or size + n > BLOCK_IDS):
                    yield from flush()
                bucket = b
                names.append(doc_id)
                held.append(np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4"))
                size += n
        if held:
            yield from flush()
        yield from close()

    return run


def write_tokens(docs: DataFrame, path: str, to: str, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, the end id after each, and write the files, ids ascending (nulls last), to a new folder.

    Documents are dealt to ranges of ids taken from the ids alone, so that texts
    are encoded once; a range is in order, and so are the ranges by their number.
    Null and empty texts are the end id alone; a text of any length is one document.
    Rows that share an id, or have none, are ordered by a hash of the text and
    then shortest first; an id with more rows than a range holds goes to several
    ranges, and so do null ids. An empty table gives no documents. Other columns of
    docs, of any name, are not looked at.
    """
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("spread"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s"), F.sum(F.when(F.col("doc_id").isNull(), F.octet_length("text"))).alias("z")).first()
    whole, without_id = size["s"] or 0, size["z"] or 0
    n = min(RANGES, whole // RANGE_BYTES + 1)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("c")).first()["c"] if n > 1 else []
    ranges = _Ranges(cuts or [], int(n * without_id / whole) if whole else 1)
    encoded = rows.mapInArrow(_encode(path, ranges), "doc_id long, spread long, n long, ids binary, bucket int")
    dealt = encoded.repartitionById(ranges.n, F.col("bucket")).sortWithinPartitions("bucket", F.col("doc_id").asc_nulls_last(), "spread", "n", "ids")
    bits = bits_for(encoder(path, END_ID).vocabulary())
    packed = dealt.select("doc_id", "n", "ids", "bucket").mapInArrow(_packer(bits, RECORDS), "block binary")
    packed.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").option("maxRecordsPerFile", RECORDS).text(to)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            data = batch.column(0)[i].as_buffer().to_pybytes()
            for block in blocks(data):
                ids = block.ids().astype("<u4")
                starts = np.concatenate(([0], block.ends[:-1])).astype(np.int64)
                view = memoryview(ids).cast("B")
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(starts.tolist(), block.ends.tolist(), strict=True)]
                n = block.n_docs
                columns = [
                    pa.array(np.full(n, block.bucket, np.int32)),
                    pa.array(np.full(n, block.number, np.int32)),
                    pa.array(block.doc_ids.astype(np.int64), mask=block.no_id),
                    pa.array(starts),
                    pa.array(block.ends - starts),
                    pa.array(np.array(crcs, np.int64)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).where("length > 0")
    found = files.select("content").mapInArrow(_reader, "bucket int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    found = scratch.keep(found, "token-digests")
    blocks_ = found.groupBy("bucket", "block").agg(F.sum("n_tokens").alias("ids"))
    # a row per block of a quarter million ids; within files first, then over the files
    order = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    of_file = blocks_.groupBy("bucket").agg(F.sum("ids").alias("ids")).select("bucket", F.coalesce(F.sum("ids").over(order), F.lit(0)).alias("file_start"))
    of_block = blocks_.select("bucket", "block", F.coalesce(F.sum("ids").over(W.partitionBy("bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("block_start"))
    out = found.join(of_block.join(of_file, "bucket"), ["bucket", "block"])
    return out.select("doc_id", (F.col("file_start") + F.col("block_start") + F.col("at")).cast("long").alias("start"), "n_tokens", "ids_crc32")
