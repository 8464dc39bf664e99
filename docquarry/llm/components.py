"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import scratch

MAX_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) to (node long, root long), root the smallest node reachable.

    Only linked nodes appear. Each round relinks the larger neighbours of a node
    to its smallest one, then the smaller ones likewise; both are a minimum per
    node and a join, so no neighbourhood is ever gathered, and the rows never
    outnumber the links. Links may repeat, come in both directions or join a node
    to itself; nulls are ignored. Every round is written to the shared folder.
    """
    spark = links.sparkSession
    low, high = F.least("a", "b"), F.greatest("a", "b")
    start = links.where("a <> b").select(high.alias("hi"), low.alias("lo")).distinct()
    now = scratch.keep(start, "links")
    for _ in range(MAX_ROUNDS):
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = now.join(least, now.lo == least.u).select("hi", F.col("m").alias("lo")).distinct()
        large = scratch.keep(large, "links")
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(first.select("hi", F.col("m").alias("lo"))).distinct()
        after = scratch.keep(small, "links")
        scratch.drop(now)
        scratch.drop(large)
        now = after
        # done when every node points straight at a node that points nowhere
        parents = now.groupBy("hi").agg(F.count(F.lit(1)).alias("n"))
        left = now.select(F.col("lo").alias("hi")).distinct().join(parents, "hi", "left_semi").select("hi").unionByName(parents.where("n > 1").select("hi"))
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = now.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(roots)
