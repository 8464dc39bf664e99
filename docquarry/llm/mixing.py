"""Mixing sources to target weights, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.text import as_row, n_words

#: A source may be repeated so often at most, on average.
MAX_RATE = 3.0
#: Weights dealt in turn to the sources in code-point order.
WEIGHTS = (1, 2, 3)
#: Seed of the draw for the fractional copy.
SEED = 7
#: Sources up to which their rates are broadcast (under 10 MB); beyond, a salted shuffle join.
BROADCAST_SOURCES = 50_000
SALTS = 32


def source_rates(totals: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate).

    Targets share the sum of all sizes by weight; none exceeds max_rate times its
    source's size, the excess being reshared by weight until none is above. That
    end is computed at once: with sources in order of cap over weight, those up to
    some place get their cap and the rest what is left, by weight. A source of
    size 0 has target and rate 0. The table has a row per source, not per document.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    ranked = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(float(max_rate)) * F.col("source_size"))
    by_level = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    after = by_level.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level)
    # the first source whose cap is above its share: all from there on get the level reached there
    ranked = ranked.withColumn("rank", F.row_number().over(by_level))
    reached = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct("rank", "level"))).over(everything)
    target = F.when(reached.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * reached["level"]))
    ranked = ranked.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_rate)))).otherwise(F.lit(0.0))
    return ranked.select("source", "source_size", "target", rate.alias("rate"))


def _with_rates(sized: DataFrame, rates: DataFrame, n_sources: int, spread: str = "doc_id") -> DataFrame:
    if n_sources <= BROADCAST_SOURCES:
        return sized.join(F.broadcast(rates.withColumnRenamed("source", "s_")), F.col("source").eqNullSafe(F.col("s_")), "left").drop("s_")
    # a hot source is dealt over SALTS tasks
    salted = sized.withColumn("salt_", F.pmod(F.xxhash64(spread, "draw_"), F.lit(SALTS)))
    each = rates.select(F.col("source").alias("s_"), "source_size", "target", "rate").withColumn("t_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(each, F.col("source").eqNullSafe(F.col("s_")) & (F.col("salt_") == F.col("t_")), "left").drop("salt_", "s_", "t_")


def draw(seed: int, doc_id: str) -> Column:
    """A number in [0, 1) from the md5 of seed and id; the same on every run, and in any SQL engine. A null id counts as none."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def mix_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, rate, copies, taken.

    copies is floor(rate), plus one when the document's draw is under the
    fraction. Null or empty texts have size 0 and are copied like others of their
    source; documents without a source form one. Rows with the same id draw alike.
    Sizes are counted in whole texts of any length. An empty table gives no rows.
    Other columns of docs, of any name, are not looked at.
    """
    sized = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`").cast("string")).alias("size"), draw(seed, id_col).alias("draw_"))
    sized = scratch.keep(sized, "sizes")
    totals = scratch.keep(sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "totals")
    rates = source_rates(totals, weights=weights, max_rate=max_rate)
    out = _with_rates(sized, rates, totals.count())
    copies = F.floor("rate") + F.when(F.col("draw_") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, max_rate: float = MAX_RATE, seed: int = SEED) -> DataFrame:
    """The rows of docs, all columns, of any name, each emitted as often as the mix takes it; rules as in mix_copies."""
    source, text = F.col(f"`{source_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    totals = scratch.keep(docs.groupBy(source.alias("source")).agg(F.sum(n_words(text)).cast("long").alias("source_size")), "totals")
    rows = docs.select(as_row(docs).alias("row"), source.alias("source"), draw(seed, id_col).alias("draw_"), *([] if (n := totals.count()) <= BROADCAST_SOURCES else [F.xxhash64(text).alias("spread_")]))
    joined = _with_rates(rows, source_rates(totals, weights=weights, max_rate=max_rate), n, "spread_")
    copies = F.floor("rate") + F.when(F.col("draw_") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.select("row", copies.cast("int").alias("copies")).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
