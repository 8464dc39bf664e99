"""Language-model scores: prediction by partial matching over bytes, and a word unigram for comparison.

Both learn from every training document. The byte model is a trie of contexts up
to ORDER bytes with the counts of what follows; an unseen symbol pays the escape
(seen symbols over count plus seen symbols) and goes to the next shorter context,
where the symbols just ruled out no longer count. The model is whole and stays
partitioned: chunks of text send their distinct codes to it by bucket and get back
a probability for each. Only contexts of up to LOW bytes, of which there are at most
256 ** LOW whatever the input, are broadcast.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.text import id_remainder, raw

FOLDS, HELD_OUT = 7, 2
#: Bytes of context at most.
ORDER = 5
#: Bytes of context whose counts every task holds: longer contexts lie by their last LOW + 1 bytes.
LOW = 2
#: Codes of the model that one task walks for codes it lacks, about.
NODES = 2_000_000
#: Bytes of text in a chunk whose counts are sent on together.
CHUNK = 16 << 20
#: Counted bytes for each bucket of a merge, about.
BUCKET = 6 << 20
#: Bytes of text whose codes are sorted together.
GROUP = 1 << 20
_START, _END = 9, 10  # white space is one space inside, so both are free

_U8, _U56 = np.uint64(8), np.uint64(56)


def normal(text: bytes | None) -> bytes:
    """Small A-Z, words joined by one space."""
    return b" ".join((text or b"").lower().split())


def joined(texts: list[bytes]) -> bytes:
    """Texts, each after ORDER start marks and with an end mark."""
    mark = bytes([_START]) * ORDER
    return b"".join([x for t in texts for x in (mark, t, b"\n")])


def codes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte that is no start mark: it and the ORDER before it, as one number; and where it lies."""
    a = np.frombuffer(buffer, np.uint8)
    n = len(a) - ORDER
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.zeros(n, np.uint64)
    for k in range(ORDER + 1):
        code = (code << _U8) | a[k : k + n]
    at = np.flatnonzero(a[ORDER:] != _START)
    return code[at], at + ORDER


def counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of every order, the context's length in the top byte, with counts."""
    return shortened(*np.unique(code, return_counts=True))


def shortened(values: np.ndarray, counts: np.ndarray, top: int = ORDER, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Codes of order top, or longer and then cut, with counts, to those of orders top to least, the order in the top byte."""
    out_v, out_c = [], []
    for order in range(top, least - 1, -1):
        if order < ORDER:
            shorter = values & np.uint64((1 << (8 * (order + 1))) - 1)
            sort = np.argsort(shorter, kind="stable")
            shorter, weight = shorter[sort], counts[sort]
            first = np.flatnonzero(np.concatenate(([True], shorter[1:] != shorter[:-1]))) if len(shorter) else np.zeros(0, np.int64)
            values, counts = shorter[first], np.add.reduceat(weight, first) if len(first) else weight
        out_v.append(values | np.uint64(order << 56))
        out_c.append(counts)
    return np.concatenate(out_v), np.concatenate(out_c)


def merged(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    v, c = np.concatenate(values), np.concatenate(counts).astype(np.int64)
    sort = np.argsort(v, kind="stable")
    v, c = v[sort], c[sort]
    first = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1]))) if len(v) else np.zeros(0, np.int64)
    return v[first], np.add.reduceat(c, first) if len(first) else c


def _mix(v: np.ndarray) -> np.ndarray:
    """Spread codes evenly over 64 bits."""
    v = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return v ^ (v >> np.uint64(29))


def _by_bucket(key: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each bucket (leading bits of key), ascending by key within it."""
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    bucket = (key[order] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
        yield int(bucket[a]), order[a:b]


class Trie:
    """Contexts of every order, sorted, with what the coder needs of each."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        orders = (values >> _U56).astype(np.int64)
        self.levels = []
        for order in range(ORDER + 1):
            mine = np.flatnonzero(orders == order)
            code = values[mine] & np.uint64((1 << 56) - 1)
            sort = np.argsort(code, kind="stable")
            code, count = code[sort], counts[mine][sort].astype(np.float64)
            context = code >> _U8
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(code) else np.zeros(0, np.int64)
            seen = np.diff(np.concatenate((first, [len(code)])))
            total = np.add.reduceat(count, first) if len(first) else np.zeros(0)
            level = {"code": code, "count": count, "context": context[first], "seen": seen.astype(np.float64), "total": total}
            if order:  # what the next shorter context counts for the symbols seen here
                below = self.levels[-1]
                shorter = code & np.uint64((1 << (8 * order)) - 1)
                at = np.minimum(np.searchsorted(below["code"], shorter), max(0, len(below["code"]) - 1))
                there = below["count"][at] * (below["code"][at] == shorter) if len(below["code"]) else np.zeros(len(code))
                level["ruled_out"] = np.add.reduceat(there, first) if len(first) else np.zeros(0)
            self.levels.append(level)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of the last byte after those before it, for codes of ORDER + 1 bytes."""
        out = np.zeros(len(code))
        left = np.arange(len(code))
        gone_mass, gone_seen = np.zeros(len(code)), np.zeros(len(code))  # ruled out by the longer context escaped from
        for order in range(ORDER, -1, -1):
            level = self.levels[order]
            if not len(level["code"]):
                continue
            mine = code[left] & np.uint64((1 << (8 * (order + 1))) - 1)
            at = np.minimum(np.searchsorted(level["context"], mine >> _U8), len(level["context"]) - 1)
            known = level["context"][at] == mine >> _U8
            mass = np.maximum(level["total"][at] - gone_mass[left], 0)
            seen = np.maximum(level["seen"][at] - gone_seen[left], 0)
            whole = mass + seen
            spot = np.minimum(np.searchsorted(level["code"], mine), len(level["code"]) - 1)
            hit = known & (level["code"][spot] == mine)
            out[left[hit]] += np.log10(level["count"][spot[hit]] / whole[hit])
            escape = known & ~hit & (whole > 0)
            out[left[escape]] += np.log10(np.maximum(seen[escape], 1e-9) / whole[escape])
            move = known & ~hit
            gone_mass[left[move]] = level["ruled_out"][at[move]] if order else 0
            gone_seen[left[move]] = level["seen"][at[move]]
            left = left[~hit]
        out[left] -= np.log10(np.maximum(256 - gone_seen[left], 1))
        return out


def _groups(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about GROUP bytes."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + ORDER + 1
        if size > GROUP or i == len(texts) - 1:
            yield slice(start, i + 1)
            start, size = i + 1, 0


def _batches(batches: Iterator[pa.RecordBatch], held: int) -> Iterator[tuple[list, list[bytes]]]:
    """(rows, normalised texts) of about CHUNK bytes; rows hold the first held columns."""
    rows: list[tuple] = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(held)]
        for row, text in zip(zip(*columns, strict=True), raw(batch, "text"), strict=True):
            t = normal(text)
            rows.append(row)
            texts.append(t)
            size += len(t)
            if size >= CHUNK:
                yield rows, texts
                rows, texts, size = [], [], 0
    if rows:
        yield rows, texts


def _in_buckets(values: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of each bucket, which holds all symbols of its contexts, ascending."""
    for b, i in _by_bucket(_mix(values >> _U8), bits):
        yield b, np.sort(i)


def _merge_low(group: pd.DataFrame) -> pd.DataFrame:
    v, c = merged([np.frombuffer(x, "<u8") for x in group["a"]], [np.frombuffer(x, "<u4") for x in group["b"]])
    return pd.DataFrame({"v": [v.astype("<u8").tobytes()], "c": [c.astype("<i8").tobytes()]})


def _merge_grams(bits: int):
    """Over a bucket's codes of all chunks. Kind 0: log10 of each of a chunk's codes, nan where no training row has it; kind 1: the
    merged counts, and kind 2 a chunk's codes without one, both by their last LOW + 1 bytes of context."""

    def suffixes(v: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        return _by_bucket(_mix((v >> _U8) & np.uint64((1 << (8 * (LOW + 1))) - 1)), bits)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(x, "<u8") for x in group["a"]]
        v, c = merged(parts, [np.frombuffer(x, "<u4") for x in group["b"]])
        logs = np.full(len(v), np.nan)
        known = np.flatnonzero(c)
        tv, tc = v[known], c[known]
        if len(tv):
            context = tv >> _U8
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
            seen = np.diff(np.concatenate((first, [len(tv)])))
            logs[known] = np.log10(tc / np.repeat(np.add.reduceat(tc, first) + seen, seen))
        out = []
        bucket = int(group["bucket"].iloc[0])
        for chunk, p in zip(group["chunk"], parts, strict=True):
            found = logs[np.searchsorted(v, p)]
            out.append((0, chunk, bucket, b"", found.astype("<f8").tobytes()))
            missed = p[np.isnan(found)]
            out += [(2, chunk, b, missed[i].astype("<u8").tobytes(), b"") for b, i in suffixes(missed)]
        out += [(1, -1, b, tv[i].astype("<u8").tobytes(), tc[i].astype("<i8").tobytes()) for b, i in suffixes(tv)]
        return pd.DataFrame(out, columns=["kind", "chunk", "bucket", "a", "b"])

    return run


def _walk(low):
    """log10 of codes that no training row has, by the shorter contexts: all that end in the same LOW + 1 bytes are here, low has the rest."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asked = group[group["kind"] == 2]
        parts = [np.frombuffer(x, "<u8") for x in asked["a"]]
        if not parts:
            return pd.DataFrame({"chunk": [], "bucket": [], "a": [], "b": []})
        model = group[group["kind"] == 1]
        empty = [np.zeros(0, np.uint64)]
        v, c = merged([np.frombuffer(x, "<u8") for x in model["a"]] or empty, [np.frombuffer(x, "<i8") for x in model["b"]] or empty)
        v, c = shortened(v.astype(np.uint64), c, least=LOW + 1)
        trie = Trie(np.concatenate((v, low.value[0])), np.concatenate((c, low.value[1])))
        distinct = np.unique(np.concatenate(parts))
        logs = trie.log10(distinct)
        return pd.DataFrame({"chunk": asked["chunk"], "bucket": asked["bucket"], "a": asked["a"], "b": [logs[np.searchsorted(distinct, p)].astype("<f8").tobytes() for p in parts]})

    return run


def _distinct(rows: list[tuple], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, ascending, with their counts in those that are not held out (0 for codes of held-out ones alone)."""
    values, counts = [], []
    for g in _groups(texts):
        for held_out in (False, True):
            v, c = np.unique(codes(joined([t for (_, h), t in zip(rows[g], texts[g], strict=True) if h is held_out]))[0], return_counts=True)
            values.append(v)
            counts.append(c * (not held_out))
        if len(values) > 6:  # repeats of codes are not held for long
            v, c = merged(values, counts)
            values, counts = [v], [c]
    return merged(values, counts)


def _tokens(bits: int):
    """Kind 0: a document, normalised, with its places among the chunk's words; of a chunk and one bucket, ascending, with training
    counts, kind 1: words, kind 2: codes, kind 3: codes cut to LOW bytes of context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "chunk", "bucket", "doc_id", "held_out", "text", "a", "b"]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
        base = TaskContext.get().partitionId() << 24
        for number, (rows, texts) in enumerate(_batches(batches, 2)):
            chunk = base + number
            index: dict[bytes, int] = defaultdict()
            index.default_factory = index.__len__
            used = []
            for text in texts:
                words = text.split(b" ") if text else []
                words.append(b"\n")
                used.append(np.unique(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)), return_counts=True))
            counts = np.zeros(len(index), np.uint32)
            for (_, held_out), (ids, n) in zip(rows, used, strict=True):
                if not held_out:
                    counts[ids] += n.astype(np.uint32)
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 9) for w in index), np.uint64, len(index))
            del index
            place = np.empty(len(hashes), np.uint32)
            place[np.argsort(hashes, kind="stable")] = np.arange(len(hashes), dtype=np.uint32)
            out = []
            for (doc_id, held_out), (ids, n), text in zip(rows, used, texts, strict=True):
                at = place[ids]
                order = np.argsort(at)
                steps = np.diff(at[order], prepend=np.uint32(0)).astype("<u4")
                out.append((0, chunk, None, doc_id, held_out, *(zlib.compress(x, 1) for x in (text, steps.tobytes(), n[order].astype("<u4").tobytes()))))
            for b, i in _by_bucket(hashes, bits):
                out.append((1, chunk, b, None, None, None, hashes[i].astype("<u8").tobytes(), counts[i].astype("<u4").tobytes()))
            values, counts = _distinct(rows, texts)
            for b, i in _in_buckets(values, bits):
                out.append((2, chunk, b, None, None, None, values[i].astype("<u8").tobytes(), counts[i].astype("<u4").tobytes()))
            values, counts = shortened(values[counts > 0], counts[counts > 0], LOW, LOW)
            for b, i in _by_bucket(_mix(values), bits):
                out.append((3, chunk, b, None, None, None, values[i].astype("<u8").tobytes(), counts[i].astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return run


def _merge_words(group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all chunks, back to each chunk in the order of its words; and a row of totals."""
    parts = [np.frombuffer(x, "<u8") for x in group["a"]]
    v, c = merged(parts, [np.frombuffer(x, "<u4") for x in group["b"]])
    back = [c[np.searchsorted(v, p)].astype("<i8").tobytes() for p in parts]
    n = len(parts)
    return pd.DataFrame({
        "chunk": [*group["chunk"], -1], "bucket": [int(group["bucket"].iloc[0])] * (n + 1), "counts": [*back, b""],
        "n": [0] * n + [int(c.sum())], "v": [0] * n + [int((c > 0).sum())],
    })


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Learns from rows outside the held-out fold, by crc32 of the id; a null id is
    in no fold and is learned from. Tokens are words and one end. base_score is
    the add-one unigram, score the byte model's, both log10, of the normalised
    text with its end. A null or empty text is an end alone. Rows that repeat are
    learned and scored each for itself. Without training rows the byte model is
    uniform and train_tokens is 0. A text of any length is learned from and scored
    whole, and an empty table gives no rows. Other columns of docs, of any name, are
    not looked at.

    Words travel as 64-bit hashes, once per chunk of text and bucket; a chunk gets
    back the global counts of its own words, so no vocabulary is ever broadcast
    and no word is a key of its own. Codes of the byte model travel alike. What no
    training row has is walked where the model's contexts of the same ending are;
    nodes sets into how many such parts the model falls, and no result.
    """
    spark = docs.sparkSession
    doc_id = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (id_remainder(doc_id, FOLDS) == HELD_OUT).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    bits = max(3, (size // BUCKET).bit_length())
    made = rows.mapInArrow(_tokens(bits), "kind int, chunk long, bucket int, doc_id long, held_out boolean, text binary, a binary, b binary")
    made = scratch.keep(made, "tokens", compression="zstd", partition_by="kind")
    words = made.where("kind = 1").select("chunk", "bucket", "a", "b")
    counts = scratch.keep(words.groupBy("bucket").applyInPandas(_merge_words, "chunk long, bucket int, counts binary, n long, v long"), "counts", compression="zstd")
    totals = counts.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n_all, v_all = totals["n"] or 0, totals["v"] or 0
    low = made.where("kind = 3").select("bucket", "a", "b").groupBy("bucket").applyInPandas(_merge_low, "v binary, c binary").collect()  # 256 ** (LOW + 1) codes at most
    low = merged([np.frombuffer(r["v"], "<u8") for r in low] or [np.zeros(0, np.uint64)], [np.frombuffer(r["c"], "<i8") for r in low] or [np.zeros(0, np.int64)])
    low = spark.sparkContext.broadcast(shortened(*low, LOW))
    grams = made.where("kind = 2").select("chunk", "bucket", "a", "b")
    wide = min(16, max(5, (size // (8 * nodes)).bit_length()))
    grams = scratch.keep(grams.groupBy("bucket").applyInPandas(_merge_grams(wide), "kind int, chunk long, bucket int, a binary, b binary"), "grams", compression="zstd", partition_by="kind")
    for kind in (1, 2, 3):  # read for the last time
        scratch.drop(f"{made._docquarry_path}/kind={kind}", spark)
    walked = grams.where("kind > 0").groupBy("bucket").applyInPandas(_walk(low), "chunk long, bucket int, a binary, b binary")

    def finish(documents: pa.Table, found: pa.Table) -> pa.Table:
        found = found.sort_by([("kind", "ascending"), ("bucket", "ascending")])
        of_kind: dict[int, list[tuple[bytes, bytes]]] = {0: [], 1: [], 2: []}
        for kind, a, b in zip(*(found[x].to_pylist() for x in ("kind", "a", "b")), strict=True):
            of_kind[kind].append((a, b))
        c = np.concatenate([np.frombuffer(x, "<i8") for _, x in of_kind[1]] or [np.zeros(0, np.int64)])
        logs = np.log10(c + 1.0)
        totals, known, base = [], [], []
        for a, b in zip(documents["a"].to_pylist(), documents["b"].to_pylist(), strict=True):
            at, n = np.cumsum(np.frombuffer(zlib.decompress(a), "<u4")), np.frombuffer(zlib.decompress(b), "<u4").astype(np.int64)
            totals.append(int(n.sum()))
            known.append(int(n[c[at] > 0].sum()))
            base.append(float((logs[at] * n).sum() - totals[-1] * np.log10(n_all + v_all + 1)))
        texts = [zlib.decompress(t) for t in documents["text"].to_pylist()]
        groups = []
        for g in _groups(texts):
            code, at = codes(joined(texts[g]))
            ends = np.cumsum([len(t) + ORDER + 1 for t in texts[g]])
            own, back = np.unique(code, return_inverse=True)
            groups.append((own, back.astype(np.uint32), np.searchsorted(at, np.concatenate(([0], ends[:-1])))))
        values = np.unique(np.concatenate([own for own, _, _ in groups]))
        logs = np.full(len(values), np.nan)
        logs[np.concatenate([i for _, i in _in_buckets(values, bits)])] = np.concatenate([np.frombuffer(x, "<f8") for _, x in of_kind[0]])
        for v, x in of_kind[2]:
            logs[np.searchsorted(values, np.frombuffer(v, "<u8"))] = np.frombuffer(x, "<f8")
        assert not np.isnan(logs).any()
        scores = np.concatenate([np.add.reduceat(logs[np.searchsorted(values, own)][back], starts) for own, back, starts in groups])
        columns = [documents["doc_id"], documents["held_out"], pa.array(totals, pa.int64()), pa.array(known, pa.int64()), pa.array([n_all] * len(totals), pa.int64()), pa.array(base, pa.float64()), pa.array(scores)]
        return pa.table(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    documents = made.where("kind = 0").select("chunk", "doc_id", "held_out", "text", "a", "b").groupBy("chunk")
    of_words = counts.where("chunk >= 0").select(F.lit(1).alias("kind"), "chunk", "bucket", F.lit(b"").alias("a"), F.col("counts").alias("b"))
    of_codes = grams.where("kind = 0").select("kind", "chunk", "bucket", "a", "b").unionByName(walked.select(F.lit(2).alias("kind"), "*"))
    by_chunk = of_words.unionByName(of_codes).groupBy("chunk")
    return documents.cogroup(by_chunk).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
