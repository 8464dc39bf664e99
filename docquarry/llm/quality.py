"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.mixing import draw
from docquarry.llm.text import id_remainder, raw

FOLDS, HELD_OUT = 5, 0
#: Score from which a document counts as good.
THRESHOLD = 0.3
#: Share of the pooled covariance in each class's, and of the scaled identity in that.
POOLED, IDENTITY = 0.10, 0.02
#: Training rows from which the two numbers of the calibration are fitted: all up to so many, else about so many.
CALIBRATION_ROWS = 4000

_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
_DIGITS, _SIGNS, _STOPS = bytes(range(48, 58)), b"#*%$&@^~=+_<>{}[]\\/|!?", b".,;:"
FEATURES = ("words", "word_length", "long_words", "distinct", "top_word", "repeats", "upper", "digits", "signs", "stops", "non_ascii", "signed_words", "lines", "line_repeats", "line_ends", "deflate", "head_distinct")


def _share(part: float, whole: float) -> float:
    """A share, as the logarithm of its odds with a small floor."""
    p = min(1.0, part / whole) if whole else 0.0
    return float(np.log((p + 0.002) / (1.002 - p)))


def statistics(text: bytes | None) -> list[float]:
    """The transformed statistics of a whole text; a text without words has them all at their floor."""
    data = text or b""
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(FEATURES)
    kept = lambda drop: size - len(data.translate(None, drop))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    letters = sum(map(len, words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    signed = sum(1 for w in words if w[-1] in _SIGNS)
    return [
        float(np.log1p(n)),
        float(np.log(letters / n)),
        _share(sum(1 for w in words if len(w) > 16), n),
        float(np.log(len(counts)) / np.log(n + 1)),
        _share(max(counts.values()), n + 10),
        _share(repeats, n),
        _share(kept(_UPPER), kept(_LETTERS) + 10),
        _share(kept(_DIGITS), size),
        _share(kept(_SIGNS), size),
        _share(kept(_STOPS), size),
        _share(size - len(data.translate(None, bytes(range(128, 256)))), size),
        _share(signed, n),
        float(np.log(n / len(lines))),
        _share(len(lines) - len(set(lines)), len(lines) + 2),
        _share(sum(1 for x in lines if x.rstrip()[-1:] in (b".", b"!", b"?")), len(lines)),
        float(np.log((len(zlib.compress(data, 1)) + 8) / (size + 64))),
        _share(len(counts), n + 10),
    ]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [statistics(t) for t in raw(batch, "text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.float64()))], ["doc_id", "x"])


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>) of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_features, "doc_id long, x array<double>")


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    p = len(FEATURES)
    total = np.zeros((2, 1 + p + p * p))
    for frame in frames:
        for y in (0, 1):
            x = np.array(frame.loc[frame["y"] == y, "x"].tolist()).reshape(-1, p)
            total[y] += np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)))
    for y in (0, 1):
        if total[y, 0]:
            yield pd.DataFrame({"y": y, "i": np.arange(total.shape[1]), "v": total[y]})


class Discriminant:
    """Two Gaussians with shrunk covariances; their Cholesky factors are kept inverted."""

    def __init__(self, counts: np.ndarray, means: np.ndarray, covariances: np.ndarray, pooled: float = POOLED, identity: float = IDENTITY):
        covariances = covariances + 1e-6 * np.eye(covariances.shape[1])  # constant statistics, and what rounding leaves of them
        both = (counts[:, None, None] * covariances).sum(axis=0) / counts.sum()
        self.scale = np.sqrt(np.diag(both)) + 1e-3
        self.means = means / self.scale
        self.factors, self.bias = [], []
        for y in (0, 1):
            weight = max(pooled, min(0.9, both.shape[0] / (both.shape[0] + counts[y])))  # few rows lean on the pooled one
            own = ((1 - weight) * covariances[y] + weight * both) / np.outer(self.scale, self.scale)
            own = (1 - identity) * own + identity * np.trace(own) / len(own) * np.eye(len(own))
            factor = np.linalg.cholesky(own)
            self.factors.append(np.linalg.inv(factor))
            self.bias.append(np.log(counts[y] / counts.sum()) - np.log(np.diag(factor)).sum())
        self.slope, self.shift = 0.3, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, with the priors."""
        scaled = x / self.scale
        density = [self.bias[y] - 0.5 * (((scaled - self.means[y]) @ self.factors[y].T) ** 2).sum(axis=1) for y in (0, 1)]
        return density[1] - density[0]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Slope and shift of the logistic curve over the difference, by damped Newton steps."""
        z = np.clip(self.difference(x), -60, 60)
        b = np.array([0.3, 0.0])
        design = np.stack([z, np.ones_like(z)], axis=1)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ b, -40, 40)))
            grad = design.T @ (p - y) + 1e-2 * (b - [0.3, 0.0])
            hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-2])
            step = np.linalg.solve(hess, grad)
            b = b - step / max(1.0, np.abs(step).max())
        self.slope, self.shift = (float(b[0]), float(b[1])) if b[0] > 0 else (0.3, 0.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.clip(self.difference(x), -1e6, 1e6) + self.shift, -40, 40)))


def fit(train: DataFrame) -> Discriminant | None:
    """train (x, y int, doc_id): all rows give the moments, a bounded number the calibration. None if a class is missing."""
    p = len(FEATURES)
    moments = train.select("x", "y").mapInPandas(_sums, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + p + p * p))
    for r in moments.collect():  # 2 * (1 + p + p * p) numbers
        total[r["y"], r["i"]] = r["v"]
    counts = total[:, 0]
    if counts.min() < 2:
        return None
    means = total[:, 1 : 1 + p] / counts[:, None]
    covariances = total[:, 1 + p :].reshape(2, p, p) / counts[:, None, None] - means[:, :, None] * means[:, None, :]
    model = Discriminant(counts, means, covariances)
    # a share by hash that gives about so many ids, one row of each; nothing is ranked
    some = train.where(draw(13, "doc_id") < CALIBRATION_ROWS / counts.sum()).groupBy("doc_id").agg(F.min(F.struct("x", "y")).alias("r")).select("r.x", "r.y").toPandas()
    if some["y"].nunique() < 2:
        return model
    model.calibrate(np.array(some["x"].tolist()), some["y"].to_numpy().astype(float))
    return model


def classify(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Learns from labelled rows outside the held-out fold, by crc32 of the id. A
    null id is in no fold and is not learned from. Null and empty texts, and texts
    without words, have all statistics zero and are scored like any other. An id
    labelled twice counts by its smallest label. If a class has no training rows,
    every score is 0.5. Texts of any length count whole; rows that repeat an id are
    scored each for itself; an empty table gives no rows; other columns of docs, of
    any name, are not looked at.
    """
    spark = docs.sparkSession
    rows = scratch.keep(features(docs, id_col=id_col, text_col=text_col), "statistics")
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label_col).cast("int").alias("y"))
    train = rows.join(known, "doc_id").where(id_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    model = spark.sparkContext.broadcast(fit(train))

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        if model.value is None:
            return pd.Series(np.full(len(x), 0.5))
        return pd.Series(model.value.score(np.array(x.tolist()).reshape(len(x), len(FEATURES))))

    out = rows.select("doc_id", (id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), score("x").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
