"""SimHash near-dedup by pigeonhole blocks.

A fingerprint's 64 bits are cut into B blocks; two fingerprints that differ in at
most D bits agree on at least B - D blocks, so every set of B - D blocks is a key
and close pairs share one. B follows from the number of fingerprints, so that a
key stays selective at any size. Hamming distance is then verified.

A similarity of shingles as low as 0.8 is beyond such keys: there 15 % of the bits
differ, and any set of blocks that surely agrees is too short to select. For it
fingerprints have 256 bits, and all are compared with all, in tiles of two chunks;
in large tiles, all that nearly agree in one of 23 blocks, as close pairs surely do.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.components import components
from docquarry.llm.text import as_row, raw, text_digest

SHINGLE = 4
SEED = 42
#: Bits by which linked fingerprints may differ.
DISTANCE = 4
#: Words of a shingle, 64-bit words of a fingerprint and bits that may differ, for a similarity (Jaccard, of shingle sets) of SIMILAR or more:
#: there 38.8 of 256 bits differ, with a standard deviation of 5.7.
SIMILAR_SHINGLE, SIMILAR, WIDTH, SIMILAR_DISTANCE = 5, 0.8, 4, 44
#: Fingerprints under one key that one task compares; larger groups are cut into tiles of pairs of such chunks.
CHUNK = 4096
_SMALL = 16
#: Where all are compared: rows of a chunk at most; chunks, if each has LEAST_CHUNK rows, so that a smaller table gives tiles to all cores.
WIDE_CHUNK, CHUNKS, LEAST_CHUNK = 1 << 19, 16, 2048
# comparisons at a time, which fit a core's cache; columns at a time, and rows of a strip of them; comparisons that cost as much as to set up a group of them
_BLOCK, _COLUMNS, _STRIP, _SETUP = 1 << 16, 8192, 64, 1 << 16
# odd numbers that spread a shingle's hash to further words of a wide fingerprint
_SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _bit_counts(digests: bytes, width: int) -> tuple[np.ndarray, int]:
    """How many of the hashes have each bit, first bit first; and how many there are."""
    total = len(digests) // 8
    ones = np.zeros(64 * width, np.int64)
    flat = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    for at in range(0, total, 1 << 15):
        part = flat[at : at + (1 << 15)]
        ones[:64] += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.uint32)
        h = part.view(">u8").ravel().astype(np.uint64)
        for w in range(1, width):
            x = (h ^ (h >> np.uint64(32))) * _SPREAD[w - 1]
            x ^= x >> np.uint64(29)
            x *= _SPREAD[w % len(_SPREAD)]
            x ^= x >> np.uint64(32)
            ones[64 * w : 64 * w + 64] += np.unpackbits(x.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return ones, total


def wide_fingerprint(text: bytes | None, shingle: int = SHINGLE, width: int = 1) -> list[int]:
    """SimHash of the UTF-8 text, as signed 64-bit numbers; 0 without words. The first is that of width 1."""
    words = (text or b"").lower().split()  # bytes: only A-Z, and only the six white-space bytes
    if not words:
        return [0] * width
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = xxhash.xxh64_digest(joined, SEED)
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)])
    ones, total = _bit_counts(digests, width)
    return np.packbits(ones * 2 > total).view(">i8").tolist()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one 64-bit word."""
    return wide_fingerprint(text, shingle)[0]


def _names(width: int) -> list[str]:
    return [f"f{w}" for w in range(width)]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, width: int = 1) -> DataFrame:
    """(doc_id long, digest binary, f0 long, …) for every row; digest is the md5 of the text, null as empty."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_digest(text).alias("digest"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([wide_fingerprint(x, shingle, width) for x in raw(batch, "text")], np.int64).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(found[:, w].copy()) for w in range(width)]], ["doc_id", "digest", *_names(width)])

    return rows.mapInArrow(run, "doc_id long, digest binary, " + ", ".join(f"{n} long" for n in _names(width)))


def key_masks(n: int, distance: int = DISTANCE) -> list[int]:
    """Bit masks of the keys, for n fingerprints: the fewest blocks whose keys have 3 bits more than log2(n)."""
    for blocks in range(distance + 1, 12):
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
        masks = [sum(c) for c in itertools.combinations(parts, blocks - distance)]
        if min(m.bit_count() for m in masks) >= max(1, n).bit_length() + 3 or blocks == 11:
            return masks
    raise AssertionError


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Rows of words that differ in at most so many bits."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.uint32) <= distance


def _forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that connect what is within distance of each other, one fewer than members per component."""
    left = np.arange(len(values))
    heads: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(values[left], values[at], distance)
            if near.any():
                new = left[near]
                heads.append(np.full(len(new), at))
                tails.append(new)
                queue.extend(new)
                left = left[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (empty, empty)


def _frame(kind: int, a: np.ndarray, b: np.ndarray, values: np.ndarray, key: int = 0, chunk: int = 0) -> pa.RecordBatch:
    n = len(a)
    columns = [np.full(n, kind, np.int32), np.full(n, key, np.int64), np.full(n, chunk, np.int32), a, b, *[values[:, w].view(np.int64).copy() for w in range(values.shape[1])]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "chunk", "a", "b", *_names(values.shape[1])])


def _linker(distance: int, chunk_rows: int):
    """Over rows (key, node, words of the fingerprint) sorted by key: kind 0 are links of nodes, kind 1 the members of groups that are too large for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_now, held, chunks = None, [], 0  # a group that may go on in the next batch: (nodes, values)

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])

        def large(nodes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            heads, tails = _forest(values, distance)
            return _frame(0, nodes[heads], nodes[tails], values[heads])

        def close() -> pa.RecordBatch:
            nodes, values = joined()
            return _frame(1, nodes, nodes, values, key_now, chunks) if chunks else large(nodes, values)

        for batch in batches:
            keys, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fps = np.stack([batch.column(i).to_numpy() for i in range(2, batch.num_columns)], axis=1).view(np.uint64)
            if not len(keys):
                continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = np.concatenate(([0], cuts, [len(keys)]))
            # the first run may continue what is held, the last one may go on
            if key_now is not None and keys[0] != key_now:
                yield close()
                key_now, held, chunks = None, [], 0
            first = 0
            if key_now is not None:
                held.append((ids[: bounds[1]], fps[: bounds[1]]))
                first = 1
                if len(bounds) > 2:
                    yield close()
                    key_now, held, chunks = None, [], 0
            last = len(bounds) - 2
            if last >= first:
                lengths = np.diff(bounds)
                inner = np.arange(first, last)
                for i in inner[lengths[inner] > _SMALL]:
                    if lengths[i] <= chunk_rows:
                        yield large(ids[bounds[i] : bounds[i + 1]], fps[bounds[i] : bounds[i + 1]])
                    else:
                        for c, at in enumerate(range(bounds[i], bounds[i + 1], chunk_rows)):
                            part = slice(at, min(at + chunk_rows, bounds[i + 1]))
                            yield _frame(1, ids[part], ids[part], fps[part], int(keys[bounds[i]]), c)
                size = np.repeat(lengths, lengths)
                lo, hi = bounds[first], bounds[last]
                ks, ns, vs, small = keys[lo:hi], ids[lo:hi], fps[lo:hi], size[lo:hi] <= _SMALL
                ks, ns, vs = ks[small], ns[small], vs[small]
                for step in range(1, _SMALL):
                    same = np.flatnonzero(ks[step:] == ks[:-step])
                    if not len(same):
                        break
                    near = same[_near(vs[same], vs[same + step], distance)]
                    if len(near):
                        yield _frame(0, ns[near], ns[near + step], vs[near])
                key_now, held = int(keys[-1]), [(ids[bounds[last] :], fps[bounds[last] :])]
            while sum(len(x) for x, _ in held) > chunk_rows:
                nodes, values = joined()
                yield _frame(1, nodes[:chunk_rows], nodes[:chunk_rows], values[:chunk_rows], key_now, chunks)
                held, chunks = [(nodes[chunk_rows:], values[chunk_rows:])], chunks + 1
        if key_now is not None:
            yield close()

    return run


def _tile(distance: int, width: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        nodes = group["node"].to_numpy()
        heads, tails = _forest(np.stack([group[n].to_numpy() for n in _names(width)], axis=1).view(np.uint64), distance)
        return pd.DataFrame({"a": nodes[heads], "b": nodes[tails]})

    return run


def links(distinct: DataFrame, masks: list[list[int]], *, distance: int = DISTANCE, chunk_rows: int = CHUNK) -> DataFrame:
    """distinct (node long, f0 long, …; no repeats) to links (a, b) of nodes that join all fingerprints that a mask's bits bring together.

    The links span the same components as all close pairs under the keys do, and
    each is a close pair; within a key's group only a spanning forest is emitted.
    A group beyond chunk_rows is cut into chunks, and each pair of chunks is a
    task of its own.
    """
    width = len(masks[0])
    words = _names(width)
    keyed = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(_signed(m)).alias(f"m{w}") for w, m in enumerate(mask)]) for i, mask in enumerate(masks)])).alias("k"), "node", *words)
    keyed = keyed.select(F.xxhash64("k.i", *[F.col(f"f{w}").bitwiseAND(F.col(f"k.m{w}")) for w in range(width)]).alias("key"), "node", *words)
    schema = "kind int, key long, chunk int, a long, b long, " + ", ".join(f"{n} long" for n in words)
    found = keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_linker(distance, chunk_rows), schema)
    found = scratch.keep(found, "close")
    direct = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select("key", "chunk", F.col("a").alias("node"), *words)
    if hot.isEmpty():
        return direct
    size = hot.groupBy("key").agg(F.max("chunk").alias("top"))
    tiles = hot.join(size, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("top")))).where("other <> chunk or top = 0")
    tiles = tiles.select("key", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "node", *words)
    return direct.unionByName(tiles.groupBy("key", "i", "j").applyInPandas(_tile(distance, width), "a long, b long"))


def _buffers() -> list[np.ndarray]:
    """Room for a block of comparisons: words, bits that differ, their sum."""
    return [np.empty(max(_BLOCK, _COLUMNS), kind) for kind in (np.uint64, np.uint8, np.uint8)]


def _close(rows: np.ndarray, columns: np.ndarray, distance: int, buffers: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all rows (up to _STRIP) and columns (their words one below the other) within distance of each other.

    Further words only add bits that differ, so the first half of them rules out
    nearly all pairs of unlike texts; the other half is compared for what is left.
    """
    half = min((len(columns) + 1) // 2, 3)  # bits of three words are counted in a byte
    step = max(1, _BLOCK // max(1, min(columns.shape[1], _COLUMNS)))
    x = np.ascontiguousarray(rows.T)[:, :, None]
    for start in range(0, columns.shape[1], _COLUMNS):
        y = columns[:, None, start : start + _COLUMNS]
        hit = np.empty((len(rows), y.shape[2]), bool)
        for top in range(0, len(rows), step):
            part = hit[top : top + step]
            m, c, t = (buffer[: part.size].reshape(part.shape) for buffer in buffers)
            for w in range(half):
                np.bitwise_count(np.bitwise_xor(x[w, top : top + step], y[w], out=m), out=c if w else t)
                if w:
                    np.add(t, c, out=t)
            np.less_equal(t, distance, out=part)
        at = np.flatnonzero(hit)
        i, j = at // hit.shape[1], at % hit.shape[1] + start
        if half < len(columns) and len(at):
            close = _near(rows[i], columns[:, j].T, distance)
            i, j = i[close], j[close]
        if len(i):
            yield i, j


def _cut(values: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Each value's bits in so many blocks, with a block's place, that of two values within distance one block differs in one bit at most."""
    blocks, bits = distance // 2 + 1, 64 * values.shape[1]
    for at, end in itertools.pairwise(bits * i // blocks for i in range(blocks + 1)):
        word, shift = divmod(at, 64)
        key = values[:, word] >> np.uint64(shift)
        if shift + end - at > 64:
            key |= values[:, word + 1] << np.uint64(64 - shift)
        yield (key & np.uint64((1 << (end - at)) - 1)).astype(np.int64), at, end - at


def _groups(values: np.ndarray, first: int, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]] | None:
    """Places of rows and columns such that each close pair of the first values with the others (of all, if all are first) is in one of these groups, and whether their block is in the first half of the words; None if all pairs cost no more."""
    n, same = len(values), first == len(values)
    pairs = first * first // 2 if same else first * (n - first)
    blocks, bits = distance // 2 + 1, 64 * values.shape[1] // (distance // 2 + 1)
    if bits > 16 or pairs <= blocks * (_SETUP << bits):
        return None
    here, there = slice(0, first), slice(0 if same else first, n)
    work = 0
    for key, _, size in _cut(values, distance):
        a, b = (np.bincount(key[part], minlength=1 << size) for part in (here, there))
        cell = np.arange(1 << size)
        work += int(a @ b) // (1 + same) + sum(int(a @ b[cell ^ (1 << k)]) for k in range(size)) // (1 + same) + _SETUP * int((a > 0).sum())
    if work >= pairs:
        return None

    def run() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        for key, at, size in _cut(values, distance):
            rows, columns = (np.argsort(key[part], kind="stable") for part in (here, there))
            r, c = (np.searchsorted(key[part][order], np.arange((1 << size) + 1)) for part, order in ((here, rows), (there, columns)))
            columns += there.start
            for v in np.flatnonzero(np.diff(r)).tolist():
                near = [u for u in (v, *(v ^ (1 << k) for k in range(size))) if u >= v or not same]
                yield rows[r[v] : r[v + 1]], np.concatenate([columns[c[u] : c[u + 1]] for u in near]), at < 32 * values.shape[1]

    return run()


def _span(values: np.ndarray, first: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (places of values within distance) that connect what all close pairs do of the first values with the others; of all values, if all are first. They are fewer than the values.

    Some values, compared with all others before, find large clusters; what is in one
    cluster already is not compared within it.
    """
    n = len(values)
    parent = np.arange(n)
    heads: list[int] = []
    tails: list[int] = []

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = int(parent[k])
        return k

    def join(i: np.ndarray, j: np.ndarray) -> None:
        a, b = parent[i], parent[j]
        apart = np.flatnonzero(a != b)
        if not len(apart):
            return
        _, once = np.unique(a[apart] * n + b[apart], return_index=True)  # one pair for each two trees
        for k in apart[once].tolist():
            p, q = root(int(i[k])), root(int(j[k]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                heads.append(int(i[k]))
                tails.append(int(j[k]))
        if len(once) > _SMALL:
            while not np.array_equal(flat := parent[parent], parent):
                parent[:] = flat

    buffers = _buffers()
    sample = np.arange(0, n, max(1, n // _SMALL))
    for i, j in _close(values[sample], np.ascontiguousarray(values.T), distance, buffers):
        join(sample[i], j)
    groups = _groups(values, first, distance)
    if groups is None:
        left = np.argsort(parent[:first], kind="stable")
        right = left if first == n else np.argsort(parent[first:], kind="stable") + first
        groups = iter([(left, right, False)])
    turned = np.ascontiguousarray(np.roll(values, values.shape[1] // 2, axis=1))  # the half that a group doesn't agree in comes first
    for left, right, early in groups:
        table = turned if early else values
        columns = np.ascontiguousarray(table[right].T)
        for top in range(0, len(left), _STRIP):
            rows = left[top : top + _STRIP]
            at = top if left is right else 0
            others, theirs = right[at:], columns[:, at:]
            if (parent[rows] == parent[rows[0]]).all():
                apart = parent[others] != parent[rows[0]]
                if not apart.all():
                    others, theirs = others[apart], np.ascontiguousarray(theirs[:, apart])
            for i, j in _close(table[rows], theirs, distance, buffers):
                join(rows[i], others[j])
    return np.array(heads, np.int64), np.array(tails, np.int64)


def _wide_tile(distance: int):
    """Over the rows (tile, side, node, words of the fingerprint) of whole tiles: links of nodes. Sides 0 and 1 are compared with each other, side 2 with itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        tile, side, node = (rows.column(i).to_numpy() for i in range(3))
        values = np.stack([rows.column(i).to_numpy() for i in range(3, rows.num_columns)], axis=1).view(np.uint64)
        for t in np.unique(tile).tolist():
            left, right = np.flatnonzero((tile == t) & (side == 0)), np.flatnonzero((tile == t) & (side == 1))
            both = np.flatnonzero(tile == t) if not len(left) + len(right) else np.concatenate((left, right))
            heads, tails = _span(values[both], len(left) or len(both), distance)
            yield pa.RecordBatch.from_arrays([pa.array(node[both[heads]]), pa.array(node[both[tails]])], ["a", "b"])

    return run


def all_links(distinct: DataFrame, n: int, *, distance: int = SIMILAR_DISTANCE, chunk_rows: int = WIDE_CHUNK) -> DataFrame:
    """The n rows of distinct (node long, f0 long, …; no repeats) to links (a, b) of nodes that join all fingerprints within distance.

    All are compared with all: rows are dealt to chunks by a hash, and each two
    chunks are a tile, compared by a task of its own, which emits a spanning forest
    of its close pairs. In large tiles only those are compared that differ in one
    bit at most of one of distance // 2 + 1 blocks, as all close pairs do. A row is
    sent once for each chunk there is.
    """
    words = [c for c in distinct.columns if c != "node"]
    chunks = max(1, -(-n // chunk_rows), min(CHUNKS, n // LEAST_CHUNK))
    i, j = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(F.col("mine") == F.col("other"), 2).when(F.col("mine") > F.col("other"), 1).otherwise(0)
    tile = (i * (2 * chunks - i + 1) / 2).cast("int") + j - i  # of the upper triangle, row by row
    sent = distinct.select("node", *words, F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int").alias("mine"))
    sent = sent.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sent = sent.select(tile.alias("tile"), side.alias("side"), "node", *words)
    return sent.repartitionById(chunks * (chunks + 1) // 2, "tile").mapInArrow(_wide_tile(distance), "a long, b long")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _grouped(rows: DataFrame, width: int, linked: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """rows of fingerprints() with first, the place (no_id, doc_id, digest) of the first row of each component; linked makes links of a number of nodes."""
    words = _names(width)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    node = F.col("f0") if width == 1 else F.xxhash64(*words)
    distinct = scratch.keep(rows.groupBy(*words).agg(F.min(place).alias("least")).withColumn("node", node), "distinct")
    found = components(linked(distinct.select("node", *words), distinct.count()))
    placed = distinct.select(F.col("node").alias("of"), "least").join(found, F.col("of") == F.col("node"), "left").select("of", "least", F.coalesce("root", "of").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("first"))
    by_node = scratch.keep(placed.join(least, "root").select("of", "first"), "placed")
    return rows.withColumn("node", node).join(by_node, F.col("node") == F.col("of"))


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fp long, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint 0 and link like any other. A text of
    fewer words than a shingle is one shingle; a text of any length is hashed
    whole, in slices. An empty table gives no rows. Rows that repeat an id share its
    row's fate; component_id is the smallest id of the component, null only if
    all its ids are null. Copies are reduced to one fingerprint first, so a group
    of any size costs one comparison. Other columns of docs, of any name, are not
    looked at.
    """
    rows = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col), "fingerprints")
    out = _grouped(rows, 1, lambda distinct, n: links(distinct, [[m] for m in key_masks(n, distance)], distance=distance))
    return out.select("doc_id", F.col("f0").alias("fp"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SIMILAR_SHINGLE, distance: int = SIMILAR_DISTANCE) -> DataFrame:
    """The rows of docs, all columns, without those that a near copy with a smaller id stands for.

    Near copies are texts of which 5-word shingles have a similarity of SIMILAR or
    more, as far as fingerprints of 256 bits tell: linked are those that differ in
    at most distance bits, and every such pair is found. A pair at exactly that
    similarity is within them with a chance of about 0.8, one at 0.85 of 0.97; one at
    0.7 of 0.2. Links are followed to whole components. Null ids come last, so that
    of a group without ids the text with the smallest md5 stays; rows equal in id and
    text stay or go together, and each other row is judged by its own text. Texts
    without words are copies of each other. Columns may have any name; an empty table gives none.
    """
    rows = scratch.keep(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, width=WIDTH), "fingerprints")
    out = _grouped(rows, WIDTH, lambda distinct, n: all_links(distinct, n, distance=distance))
    kept = out.where(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(as_row(docs).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_digest(text).alias("digest"))
    return whole.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi").select("row.*")
