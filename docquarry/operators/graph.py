"""Reference graphs: edges, both directions, reachability, forest cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import scratch

#: Steps of reach after which the rest of the graph is contracted.
STEPS = 12


def children(edges: DataFrame) -> DataFrame:
    """(src, ord, dst) to (src, children array<struct<ord, dst>>), in order; a node's own references bound the array."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("ord", "dst"))).alias("children"))


def references_from(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node)


def references_to(edges: DataFrame) -> DataFrame:
    """Distinct referrers of each target."""
    return edges.groupBy("dst").agg(F.count_distinct("src").alias("referrers"), F.min("src").alias("first_referrer"))


def reach(edges: DataFrame, roots: DataFrame, *, max_depth: int | None = None) -> DataFrame:
    """edges (src, dst), roots (node) to (node, depth, parent): shortest depth, and the smallest parent at that depth.

    A frontier is joined step by step, anti-joined with what was reached, so that
    cycles end and every node is expanded once. It goes on until nothing is new;
    with max_depth, what lies deeper is an error. Each frontier is written to the
    shared folder. What lies deeper than STEPS is found by contraction.
    """
    kind = edges.schema["dst"].dataType
    found = edges.select("src", "dst").where("src is not null and dst is not null")
    start = roots.where("node is not null").select(F.col("node").cast(kind).alias("node")).distinct()
    reached = frontier = scratch.keep(start.select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent")), "reached")
    for depth in range(1, STEPS + 1):
        step = frontier.join(found, F.col("node") == F.col("src")).groupBy("dst").agg(F.min("src").alias("parent"))
        step = step.select(F.col("dst").alias("node"), F.lit(depth).alias("depth"), "parent")
        frontier = scratch.keep(step.join(reached.select("node"), "node", "left_anti"), "frontier")
        if frontier.isEmpty():
            return reached
        if max_depth is not None and depth > max_depth:
            raise ValueError(f"nodes lie deeper than {max_depth} steps")
        reached = reached.unionByName(frontier)
    inner = reached.where(F.col("depth") < STEPS).select("node")
    rest = found.join(reached.select(F.col("node").alias("dst")), "dst", "left_anti").join(inner.withColumnRenamed("node", "src"), "src", "left_anti")
    deep = _reach_deep(rest, frontier.select("node", "depth"))
    if max_depth is not None and not deep.where(F.col("depth") > max_depth).isEmpty():
        raise ValueError(f"nodes lie deeper than {max_depth} steps")
    return reached.unionByName(deep.select("node", F.col("depth").cast("int").alias("depth"), F.col("parent").cast(kind).alias("parent")))


def _reach_deep(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, depth, parent) of what roots (node, depth) lead to by edges that never end in a root; the roots are left out.

    A node that one edge alone leads to lies one below that edge's start, so such
    nodes point to their parents, and the pointers are doubled until each shows an
    anchor: a root, a node without edges to it, or one with several. Chains and trees
    of any depth take as many rounds as the depth has binary digits. Then depths are
    lowered along the paths between anchors, as many rounds as a shortest path has
    anchors with several edges, which is the depth at most.
    """
    edges = scratch.keep(edges.select("src", "dst").distinct(), "edges")
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("up"))
    # (node, up, far): up lies far steps above; open while up may point on
    jumps = scratch.keep(into.where("n = 1").select(F.col("dst").alias("node"), "up", F.lit(1).cast("long").alias("far"), F.lit(True).alias("open")), "jumps")
    rounds, single = 0, jumps.count()
    while not jumps.where("open").isEmpty():
        above = jumps.select(F.col("node").alias("up"), F.col("up").alias("up_"), F.col("far").alias("far_"), F.col("open").alias("open_"))
        joined = jumps.where("open").join(above, "up", "left")
        on = joined.select("node", F.coalesce("up_", "up").alias("up"), (F.col("far") + F.coalesce("far_", F.lit(0))).alias("far"), F.col("up_").isNotNull().alias("open"))
        doubled = scratch.keep(jumps.where("not open").unionByName(on), "jumps")
        scratch.drop(jumps)
        jumps, rounds = doubled, rounds + 1
        if 1 << rounds > 4 * single:  # a pointer that is open after so many steps runs in a circle that nothing leads into
            break
    closed = jumps.where("not open")
    # paths between anchors: an edge into a node with several, from where its start hangs
    several = edges.join(into.where("n > 1").select("dst"), "dst", "left_semi")
    hung = several.join(closed.select(F.col("node").alias("src"), "up", "far"), "src", "left")
    paths = scratch.keep(hung.select(F.coalesce("up", "src").alias("src"), "dst", (F.coalesce("far", F.lit(0)) + 1).alias("far")).groupBy("src", "dst").agg(F.min("far").alias("far")), "paths")
    depths = changed = scratch.keep(roots.select("node", F.col("depth").cast("long").alias("depth")), "anchors")
    while True:
        step = changed.join(paths, F.col("node") == F.col("src")).groupBy("dst").agg(F.min(F.col("depth") + F.col("far")).alias("new_"))
        known = depths.select(F.col("node").alias("dst"), F.col("depth").alias("old_"))
        lower = scratch.keep(step.join(known, "dst", "left").where("old_ is null or new_ < old_").select(F.col("dst").alias("node"), F.col("new_").alias("depth")), "lower")
        if lower.isEmpty():
            break
        merged = scratch.keep(depths.unionByName(lower).groupBy("node").agg(F.min("depth").alias("depth")), "anchors")
        if changed is not depths:
            scratch.drop(changed)
        scratch.drop(depths)
        depths, changed = merged, lower
    below = closed.join(depths.select(F.col("node").alias("up"), "depth"), "up").select("node", (F.col("depth") + F.col("far")).alias("depth"))
    everything = scratch.keep(depths.unionByName(below), "depths")
    for table in (jumps, paths, depths, changed):
        scratch.drop(table)
    above = everything.select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    parents = edges.join(above, "src").join(everything.select(F.col("node").alias("dst"), "depth"), ["dst", "depth"]).groupBy("dst", "depth").agg(F.min("src").alias("parent"))
    deep = scratch.keep(parents.select(F.col("dst").alias("node"), "depth", "parent"), "deep")
    scratch.drop(edges)
    scratch.drop(everything)
    return deep


def unreached(nodes: DataFrame, reached: DataFrame) -> DataFrame:
    """Nodes that no root leads to: roots of their own in a forest cover."""
    return nodes.select("node").distinct().join(reached.select("node"), "node", "left_anti")
