"""Toxicity by nearest labelled examples, by TF-IDF cosine over a block-max inverted index.

The examples are a bounded choice of labelled documents; every term that one of
them has is in the index. Document frequencies are counted over the whole corpus,
and how terms go with the label over all labelled rows. A term weighs its
frequency times idf times a factor between FLOOR and 1, larger the more it goes
with either label: plain cosine (a factor of 1) finds neighbours by chance words.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry import scratch
from docquarry.llm.mixing import draw
from docquarry.llm.text import as_row, id_remainder, raw

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Labelled documents that become examples, of either class: all up to so many, else a share by hash that gives about so many.
#: The classifier's documented bound.
EXAMPLES = 2000
NEIGHBOURS = 15
#: Examples of a block, of which each term keeps its largest weight; blocks searched before any is left out.
BLOCK, FIRST_BLOCKS = 128, 4
#: Share of the examples from which a term counts as common; queries that are searched side by side.
COMMON, TOGETHER = 0.06, 128
#: Least factor of a term, the root of the likelihood ratio at which an association is half believed, and the log odds ratio of a strong one.
FLOOR, BELIEF, STRONG = 0.25, 7.0, 3.0
#: What is added to a distance, and votes of the prior beside the neighbours'.
SOFTEN, PRIOR = 0.1, 0.05
#: Bytes of a longer word's beginning, which is a term of its own.
PREFIX = 6
#: Labelled ids up to which they are broadcast (some 32 MB); beyond, a shuffle join.
BROADCAST_IDS = 1_000_000
#: Parts into which counts per term are cut on their way, and tasks whose counts are added at once.
SEGMENTS, TASKS = 64, 256
#: Words that a worker remembers, and rows that it scores before it hands them on.
REMEMBER, SLICE = 150_000, 512

# capitals to small letters, ASCII signs to spaces
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def words_of(text: bytes | None) -> Counter:
    return Counter((text or b"").translate(_FOLD).split())


def _hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and of its beginning (0 for short words)."""
    word = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    start = np.fromiter((xxhash.xxh64_intdigest(w[:PREFIX], 1) if len(w) > PREFIX else 0 for w in words), np.uint64, len(words))
    return word, start


def term_hashes(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of a whole text as 64-bit hashes, ascending, with counts: words, and beginnings by the number of different words that have them."""
    counts = words_of(text)
    word, start = _hashes(list(counts))
    start, n = np.unique(start[start > 0], return_counts=True)
    both, number = np.concatenate((word, start)), np.concatenate((np.fromiter(counts.values(), np.int64, len(counts)), n))
    order = np.argsort(both)
    return both[order], number[order]


class Vocabulary:
    """Terms of the examples by number, found by hash; a worker remembers the words it met lately."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.memo: dict[bytes, int] = {}

    def __getstate__(self):
        return self.hashes

    def __setstate__(self, hashes):
        self.__init__(hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each hash, -1 for none."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def terms(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of a text's known terms, and their counts."""
        counts, memo = words_of(text), self.memo
        new = [w for w in counts if w not in memo]
        if new:
            word, start = _hashes(new)
            memo.update(zip(new, (((self.find(word) + 1) << 32) | (self.find(start) + 1)).tolist(), strict=True))
        both = np.fromiter(map(memo.__getitem__, counts), np.int64, len(counts))
        if len(memo) > REMEMBER:
            memo.clear()
        word, start = (both >> 32) - 1, (both & 0xFFFFFFFF) - 1
        known = word >= 0
        start, n = np.unique(start[start >= 0], return_counts=True)
        return np.concatenate((word[known], start)), np.concatenate((np.fromiter(counts.values(), np.int64, len(counts))[known], n))


class BlockMaxIndex:
    """Exact cosine search over sparse vectors, in blocks of examples.

    Terms that few examples have are lists of (example, weight), added up first.
    The others have a weight for every example and, for each block, their largest.
    A block is left out when what its examples got so far and the largest weights
    of the rest stay under the k-th best found.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray, block: int = BLOCK, common: float = COMMON):
        self.weight, self.block, self.n = weight, block, len(vectors)
        self.blocks = max(1, -(-self.n // block))
        lengths = np.array([len(t) for t, _ in vectors], np.int64)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        value = np.concatenate([self.weigh(t, c) for t, c in vectors] or [np.zeros(0)]).astype(np.float32)
        member = np.repeat(np.arange(len(vectors), dtype=np.int32), lengths)
        frequent = np.flatnonzero(np.bincount(term, minlength=len(weight)) > common * max(1, self.n))
        self.slot = np.full(len(weight), -1, np.int32)
        self.slot[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((self.blocks, len(frequent), block), np.float32)
        wide = self.slot[term] >= 0
        self.dense[member[wide] // block, self.slot[term[wide]], member[wide] % block] = value[wide]
        self.highest = np.ascontiguousarray(self.dense.max(axis=2, initial=0).T)
        order = np.lexsort((member[~wide], term[~wide]))
        self.member, self.value = member[~wide][order], value[~wide][order]
        self.start = np.searchsorted(term[~wide][order], np.arange(len(weight) + 1))

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF with logarithmic counts, of length 1."""
        w = (1 + np.log(counts)) * self.weight[terms]
        norm = np.sqrt((w * w).sum())
        return w / norm if norm > 0 else w

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query's (terms, counts) the (examples, cosines) of the k nearest with a cosine above 0, nearest first, ties by number.

        Queries go side by side, so that a block's weights are read once for all that
        need it. without names an example for each query that is left out.
        """
        out = []
        for at in range(0, len(queries), TOGETHER):
            out += self._some(queries[at : at + TOGETHER], k, None if without is None else without[at : at + TOGETHER])
        return out

    def _some(self, queries: list, k: int, without: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n, width = len(queries), self.blocks * self.block
        lengths = [len(t) for t, _ in queries]
        if not self.n or not sum(lengths):
            return [(np.zeros(0, np.int64), np.zeros(0))] * n
        terms = np.concatenate([t for t, _ in queries])
        w = np.concatenate([self.weigh(t, c) for t, c in queries]).astype(np.float32)
        query = np.repeat(np.arange(n), lengths)
        slot = self.slot[terms]
        rare, wide = slot < 0, slot >= 0
        first, length = self.start[terms[rare]], self.start[terms[rare] + 1] - self.start[terms[rare]]
        at = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
        scores = np.bincount(np.repeat(query[rare] * width, length) + self.member[at], np.repeat(w[rare], length) * self.value[at], n * width).astype(np.float32).reshape(n, self.blocks, self.block)
        dense = np.zeros((n, self.dense.shape[1]), np.float32)
        dense[query[wide], slot[wide]] = w[wide]
        bound = scores.max(axis=2) + dense @ self.highest + np.float32(1e-5)  # for the rounding of sums
        done = np.zeros((n, self.blocks), bool)
        take = min(FIRST_BLOCKS, self.blocks)
        top = np.argpartition(-bound, take - 1, axis=1)[:, :take]
        done[np.arange(n)[:, None], top] = True

        def add(chosen: np.ndarray) -> None:
            for b in np.flatnonzero(chosen.any(axis=0)).tolist():
                mine = np.flatnonzero(chosen[:, b])
                scores[mine, b] += dense[mine] @ self.dense[b]

        add(done)
        if without is not None:
            out = np.asarray(without)
            scores[np.arange(n), out // self.block, out % self.block] = -np.inf
        found = scores[np.arange(n)[:, None], top].reshape(n, -1)
        least = -np.partition(-found, k - 1, axis=1)[:, k - 1] if found.shape[1] > k else np.zeros(n, np.float32)
        rest = ~done & (bound >= np.maximum(least, 1e-30)[:, None])
        add(rest)
        scores[~(done | rest)] = 0
        scores = scores.reshape(n, width)
        near = np.argpartition(-scores, k, axis=1)[:, :k] if width > k else np.tile(np.arange(width), (n, 1))
        cut = np.take_along_axis(scores, near, axis=1).min(axis=1)
        answer = []
        for i in range(n):
            mine = np.flatnonzero(scores[i] >= max(float(cut[i]), 1e-30))
            mine = mine[np.lexsort((mine, -scores[i, mine]))][:k]
            answer.append((mine, scores[i, mine].astype(np.float64)))
        return answer


class Voter:
    """Neighbours vote by 1 / (distance + SOFTEN); a class that was sampled more thinly counts for more; a logistic curve makes it a probability."""

    def __init__(self, vocabulary: Vocabulary, index: BlockMaxIndex, ids: np.ndarray, labels: np.ndarray, rates: tuple[float, float], prior: float):
        self.vocabulary, self.index, self.ids, self.labels, self.rates, self.prior = vocabulary, index, ids, labels, np.array(rates), prior
        self.slope, self.shift = 1.0, 0.0

    def odds(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """Log odds of the votes."""
        weight = self.rates[self.labels[found]] / (1 - np.minimum(cosines, 1.0) + SOFTEN)
        toxic = float(weight[self.labels[found] == 1].sum())
        return float(np.log((toxic + PRIOR * self.prior) / (weight.sum() - toxic + PRIOR * (1 - self.prior))))

    def probability(self, odds):
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -40, 40)))

    def calibrate(self, odds: np.ndarray, labels: np.ndarray) -> None:
        """Slope and shift by damped Newton steps, each class in its natural share."""
        weight, b, rest = self.rates[labels], np.array([1.0, 0.0]), np.array([1.0, 0.0])
        design = np.stack([odds, np.ones_like(odds)], axis=1)
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(design @ b, -40, 40)))
            step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), design.T @ (weight * (p - labels)) + 0.1 * (b - rest))
            b = b - step / max(1.0, np.abs(step).max())
        self.slope, self.shift = (float(b[0]), float(b[1])) if b[0] > 0 else (1.0, 0.0)

    def score(self, texts: list[bytes | None]) -> list[tuple[float, list[tuple[int, float]]]]:
        """For each text the probability that it is toxic, and the neighbours (example id, cosine) that voted."""
        near = self.index.nearest([self.vocabulary.terms(t) for t in texts], NEIGHBOURS)
        return [(float(self.probability(self.odds(found, cosines))), list(zip(self.ids[found].tolist(), cosines.tolist(), strict=True))) for found, cosines in near]


def association(toxic: np.ndarray, clean: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """How far a term goes with either label, 0 to 1, from how many toxic and clean rows of n1 and n0 have it."""
    toxic, clean = np.asarray(toxic, float), np.asarray(clean, float)

    def part(seen, row, column):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) * (n1 + n0) / np.maximum(row * column, 1e-9)), 0)

    both, neither = toxic + clean, n1 + n0 - toxic - clean
    ratio = 2 * (part(toxic, both, n1) + part(clean, both, n0) + part(n1 - toxic, neither, n1) + part(n0 - clean, neither, n0))
    root = np.sqrt(np.maximum(ratio, 0))
    odds = np.log((toxic + 0.5) / (n1 - toxic + 0.5) * (n0 - clean + 0.5) / (clean + 0.5))
    return root**4 / (root**4 + BELIEF**4) * np.tanh(np.abs(odds) / STRONG) ** 2


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        least = np.zeros((batch.num_rows, 2), np.int64)
        for i, text in enumerate(raw(batch, "text")):
            words = (text or b"").translate(_FOLD).split()
            shingles = {b" ".join(x) for x in zip(words, words[1:], words[2:], strict=False)} or {b" ".join(words)}
            h = np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles))
            least[i] = np.array([h.min(), (h * np.uint64(0x9E3779B97F4A7C15)).min()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(least[:, 0].copy()), pa.array(least[:, 1].copy())], ["doc_id", "y", "h1", "h2"])


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [term_hashes(t) for t in raw(batch, "text")]
        columns = [batch.column(0), batch.column(1), pa.array([h.astype("<u8").tobytes() for h, _ in found], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "y", "terms", "counts"])


def _counter(shared):
    """Rows with each of the vocabulary's terms in one task: all, labelled toxic, labelled clean; by segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        seen = np.zeros((3, len(vocabulary.hashes)), np.int64)
        rows = np.zeros(3, np.int64)
        # by text first: a common word's hash is taken once for many documents
        words, starts = [Counter() for _ in seen], [Counter() for _ in seen]

        def settle() -> None:
            for kind in range(3):
                for held, seed in ((words[kind], 0), (starts[kind], 1)):
                    hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in held), np.uint64, len(held))
                    at, n = vocabulary.find(hashes), np.fromiter(held.values(), np.int64, len(held))
                    np.add.at(seen[kind], at[at >= 0], n[at >= 0])
                    held.clear()

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), raw(batch, "text"), strict=True):
                different = set((text or b"").translate(_FOLD).split())
                begun = {w[:PREFIX] for w in different if len(w) > PREFIX}
                for kind in (0,) if y is None else (0, 2 - y):
                    words[kind].update(different)
                    starts[kind].update(begun)
                    rows[kind] += 1
                if len(words[0]) > REMEMBER:
                    settle()
        settle()
        part = TaskContext.get().partitionId() // TASKS
        cuts = np.linspace(0, seen.shape[1], SEGMENTS + 1).astype(int)
        packed = [zlib.compress(np.ascontiguousarray(seen[:, a:b]).astype("<i8").tobytes(), 1) for a, b in zip(cuts, cuts[1:], strict=False)] + [zlib.compress(rows.astype("<i8").tobytes())]
        yield pa.RecordBatch.from_arrays([pa.array(range(SEGMENTS + 1), pa.int32()), pa.array([part] * (SEGMENTS + 1), pa.int32()), pa.array(packed, pa.binary())], ["segment", "part", "counts"])

    return run


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = 0
    for x in group["counts"]:
        total = total + np.frombuffer(zlib.decompress(x), "<i8")
    return pd.DataFrame({"segment": [int(group["segment"].iloc[0])], "counts": [zlib.compress(total.astype("<i8").tobytes(), 1)]})


def _joined(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """known (doc_id, y) beside rows; broadcast if its size allows, so that texts stay where they are."""
    return rows.join(F.broadcast(known) if known.count() <= BROADCAST_IDS else known, "doc_id", how)


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> Voter | None:
    """A voter over about examples documents of either class, or all if there are fewer, chosen by a hash of the id.

    Only ids outside the held-out fold are learned from. Labelled rows of one label
    and both least shingle hashes alike are copies, of which one is learned from.
    The driver gets the examples' terms, bounded by the examples, and three counts
    for each; texts stay. Each example's own label is left out when its neighbours'
    votes calibrate the curve. None if a class has no example.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    known = scratch.keep(known.where((id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("y").isin(0, 1)), "labelled")
    sketched = _joined(rows, known, "inner").select("doc_id", "y", "text").mapInArrow(_sketches, "doc_id long, y int, h1 long, h2 long")
    known = scratch.keep(sketched.groupBy("y", "h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "y").distinct(), "known")
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    # a share by hash, not the first so many: nothing is ranked, and the driver gets no candidates
    share = F.when(F.col("y") == 1, F.lit(examples / sizes[1])).otherwise(F.lit(examples / sizes[0]))
    chosen = scratch.keep(known.where(draw(11, "doc_id") < share), "chosen")
    # of rows that repeat an id, one text
    texts = _joined(rows, chosen, "inner").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    found = scratch.keep(texts.select("doc_id", "y", "text").mapInArrow(_example_terms, "doc_id long, y int, terms binary, counts binary"), "examples")
    got = found.collect()
    y = np.array([r["y"] for r in got])
    if not len(got) or y.min() == y.max():
        return None
    hashes = [np.frombuffer(r["terms"], "<u8") for r in got]
    vocabulary = Vocabulary(np.unique(np.concatenate(hashes)))
    shared = spark.sparkContext.broadcast(vocabulary)
    counted = _joined(rows, known, "left").select("y", "text").mapInArrow(_counter(shared), "segment int, part int, counts binary")
    counted = counted.groupBy("segment", "part").applyInPandas(_added, "segment int, counts binary").groupBy("segment").applyInPandas(_added, "segment int, counts binary")
    parts = {r["segment"]: np.frombuffer(zlib.decompress(r["counts"]), "<i8") for r in counted.collect()}
    n_all, n1, n0 = parts.pop(SEGMENTS)
    seen, toxic, clean = np.concatenate([parts[s].reshape(3, -1) for s in range(SEGMENTS)], axis=1)
    idf = np.log((1 + n_all) / (1 + seen)) + 1e-6
    weight = idf * (FLOOR + (1 - FLOOR) * association(toxic, clean, float(max(n1, 1)), float(max(n0, 1))))
    vectors = [(vocabulary.find(h), np.frombuffer(r["counts"], "<u4").astype(np.int64)) for h, r in zip(hashes, got, strict=True)]
    # like examples share blocks: by the commonest word of their text, which tells the language, and the label
    common = [int(t[np.lexsort((t, -c))[0]]) if len(t) else -1 for t, c in vectors]
    order = sorted(range(len(got)), key=lambda i: (common[i], int(y[i]), len(vectors[i][0]), got[i]["doc_id"]))
    index = BlockMaxIndex([vectors[i] for i in order], weight)
    ids, labelled = np.array([got[i]["doc_id"] for i in order], np.int64), y[order]
    rates = tuple(sizes[c] / max(1, int((y == c).sum())) for c in (0, 1))
    voter = Voter(vocabulary, index, ids, labelled, rates, sizes[1] / (sizes[0] + sizes[1]))
    place = {int(i): k for k, i in enumerate(ids)}
    model = spark.sparkContext.broadcast((voter, place))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter, place = model.value
        for batch in batches:
            queries = [(voter.vocabulary.find(np.frombuffer(t, "<u8")), np.frombuffer(c, "<u4").astype(np.int64)) for t, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            odds = [voter.odds(*found) for found in voter.index.nearest(queries, NEIGHBOURS, [place[i] for i in batch.column(0).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(odds, pa.float64())], ["y", "odds"])

    votes = found.repartition(spark.sparkContext.defaultParallelism).mapInArrow(own, "y int, odds double").collect()  # a row per example
    voter.calibrate(np.array([r["odds"] for r in votes]), np.array([r["y"] for r in votes]))
    return voter


def classify(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", examples: int = EXAMPLES) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row of docs.

    evidence lists all neighbours that voted as "id:cosine", nearest first. Texts
    that share no term with any example, empty and null ones included, have no
    neighbour and get the prior. A text of any length counts whole. A null id is
    in no fold and is not learned from; an id labelled twice counts as toxic if
    either label does; rows that repeat an id are scored each for itself. Without
    examples of both classes every score is 0. An empty table gives no rows. Other
    columns of docs, of any name, are not looked at.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = score_rows(slim, fit(docs, labels, label_col=label_col, id_col=id_col, text_col=text_col, examples=examples), keep=["doc_id"])
    doc_id = F.col("row.doc_id")
    return out.select(doc_id.alias("doc_id"), (id_remainder(doc_id, FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted", "evidence")


def score_rows(docs: DataFrame, model: Voter | None, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(row struct, score, predicted, evidence): a row per row of docs, its columns (or those in keep) as they were, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # the text is taken out of the row where it is in it, so that it goes to Python once
    inside = keep is None and docs.schema[text_col].dataType == T.StringType()
    rows = docs.select(as_row(docs.select(*keep) if keep else docs).alias("row"), *([] if inside else [F.col(f"`{text_col}`").cast("string").alias("text")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voter = shared.value
        # in slices, so that few texts are Python's at once
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            texts = batch.column(0).field(text_col).cast(pa.binary()).to_pylist() if inside else raw(batch, "text")
            found = voter.score(texts) if voter else [(0.0, [])] * batch.num_rows
            scores = [s for s, _ in found]
            evidence = [" ".join(f"{i}:{c:.4f}" for i, c in e) for _, e in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, pa.string())], ["row", "score", "predicted", "evidence"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.StringType())]))
