"""Snapshots: newest and as-of lookup, change log, offsets, gaps, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], version: str, *, upto: Column | None = None) -> DataFrame:
    """The row of the greatest version for each key, or of the greatest not above upto (backward as-of).

    max_by over a struct: a partial aggregate runs before the shuffle, nothing is sorted.
    """
    rows = df if upto is None else df.where(F.col(version) <= upto)
    others = [c for c in df.columns if c not in keys]
    # ties on the version are settled by the other columns, in order
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in others if c != version])).alias("r"))
    return best.select(*keys, *[F.col("r").getField(c).alias(c) for c in others])


def first_seen(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Per version and key: added where the key appears for the first time, else modified."""
    one = df.select(*keys, version).distinct()
    first = F.min(version).over(W.partitionBy(*keys))
    return one.withColumn("change", F.when(F.col(version) == first, F.lit("added")).otherwise(F.lit("modified")))


def removed(df: DataFrame, keys: list[str], version: str, *, next_version: Column) -> DataFrame:
    """Keys of a version that the next one lacks, under the next one's number. next_version follows from the version column."""
    one = df.select(*keys, version).distinct()
    last = one.agg(F.max(version).alias("last_"))
    before = one.withColumn(version, next_version)
    gone = before.join(one, [*keys, version], "left_anti")
    return gone.join(F.broadcast(last), gone[version] <= F.col("last_")).select(*keys, version)


def incoherent(body: DataFrame, listed: DataFrame, freed: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the body that the table of contents doesn't list, or that it lists as free."""
    b = body.select(*keys).distinct()
    return b.join(listed.select(*keys).distinct(), keys, "left_anti").unionByName(b.join(freed.select(*keys).distinct(), keys, "left_semi")).distinct()


def offsets(df: DataFrame, group: list[str], order: list[str], size: Column) -> DataFrame:
    """start and stop of each part, its parts laid end to end within the group."""
    w = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("size", size.cast("long")).withColumn("start", F.coalesce(F.sum("size").over(w), F.lit(0)).cast("long")).withColumn("stop", F.col("start") + F.col("size"))


def container_offset(parts: DataFrame, keys: list[str], ordinal: str, container: int = 0, header: int = 20) -> DataFrame:
    """offset of each part counted from its container's: container's start, its own start and a fixed header."""
    outer = parts.where(F.col(ordinal) == container).select(*keys, F.col("start").alias("container_start"))
    return parts.join(outer, keys, "left").withColumn("offset", F.col("container_start") + F.col("start") + F.lit(header))


def gaps(df: DataFrame, key: str) -> DataFrame:
    """Missing numbers between the least and greatest key, as rows.

    Runs are found with lead(), partition by partition of a range, so that a
    sequence is made for each gap only and no full range of numbers is joined.
    """
    span = 1 << 16
    one = df.select(F.col(key).cast("long").alias("k")).distinct()
    block = F.floor(F.col("k") / span)
    inside = one.withColumn("next_", F.lead("k").over(W.partitionBy(block).orderBy("k"))).where("next_ > k + 1").select(F.explode(F.sequence(F.col("k") + 1, F.col("next_") - 1)).alias(key))
    # between the last key of a block and the first of the next one that has any: a row per block
    edges = one.groupBy(block.alias("b")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    across = edges.withColumn("next_", F.lead("lo").over(W.orderBy("b"))).where("next_ > hi + 1").select(F.explode(F.sequence(F.col("hi") + 1, F.col("next_") - 1)).alias(key))
    return inside.unionByName(across)


def previous(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """The value of the row before within the group."""
    return df.withColumn(name, F.lag(value).over(W.partitionBy(*group).orderBy(*order)))


def resolve(edges: DataFrame, objects: DataFrame, *, dst: str, object_id: str, value: str) -> DataFrame:
    """Each reference with the value that it names; missing where there is none."""
    target = objects.select(F.col(object_id).alias("target_"), F.col(value).alias("value"))
    return edges.join(target, F.col(dst) == F.col("target_"), "left").withColumn("missing", F.col("target_").isNull()).drop("target_")


def fill(main: DataFrame, other: DataFrame, keys: list[str], columns: list[str], how: str = "full_outer") -> DataFrame:
    """Columns of main where it has them, else of other."""
    b = other.select(*keys, *[F.col(c).alias(c + "_") for c in columns])
    return main.join(b, keys, how).select(*keys, *[F.coalesce(c, c + "_").alias(c) for c in columns])


def next_in_order(df: DataFrame, key: str, name: str) -> DataFrame:
    """Each distinct key with the next greater one; ranges of keys are ordered apart, and joined at their ends."""
    span = 1 << 16
    one = df.select(F.col(key).cast("long").alias(key)).distinct()
    block = F.floor(F.col(key) / span)
    inside = one.withColumn(name, F.lead(key).over(W.partitionBy(block).orderBy(key)))
    first = one.groupBy(block.alias("block_")).agg(F.min(key).alias("lo_"), F.max(key).alias(key))
    across = first.withColumn("after_", F.lead("lo_").over(W.orderBy("block_"))).select(key, "after_")  # a row per block
    return inside.join(across, key, "left").select(key, F.coalesce(name, "after_").alias(name))
