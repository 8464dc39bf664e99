"""Embedding near-dedup by hierarchical navigable small-world graphs, one per shard.

Equal vectors are one node with a weight. The nodes of a label are dealt to shards
of bounded size; each shard has its graph, and every node is searched in every
shard of its label. Beams widen until an audit against exact search over the shard
finds its recall; a link stands only if its cosine passes in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry import scratch
from docquarry.llm.components import components

COSINE = 0.98
#: Nodes of a shard, on average at most.
SHARD = 8192
#: Links of a node on the upper layers (twice as many on the lowest), beam while building.
M, BEAM_BUILD = 12, 40
#: First beam of a search, queries of an audit, and the recall that it must find.
BEAM, AUDIT, RECALL = 48, 48, 0.99
#: Shards of a tile at most: a task compares two tiles.
TILE = 8
_BATCH = 256


class Graph:
    """Adjacency per layer (-1: no link) over unit vectors, built in batches that are searched side by side."""

    def __init__(self, vectors: np.ndarray, seed: int = 5):
        self.x = vectors
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(M)).astype(int), 6)
        self.layers = [np.full((n, 2 * M if level == 0 else M), -1, np.int32) for level in range(int(self.level.max(initial=0)) + 1)]
        order = rng.permutation(n)
        self.entry, self.top = (int(order[0]), int(self.level[order[0]])) if n else (0, 0)
        done = 1
        while done < n:
            batch = order[done : done + min(_BATCH, max(1, done // 2))]
            self._insert(batch)
            done += len(batch)

    @classmethod
    def restore(cls, vectors: np.ndarray, layers: list[np.ndarray], entry: int, top: int) -> Graph:
        self = cls.__new__(cls)
        self.x, self.layers, self.entry, self.top = vectors, layers, entry, top
        return self

    def _insert(self, batch: np.ndarray) -> None:
        x, level = self.x[batch], self.level[batch]
        at = np.full((len(batch), 1), self.entry, np.int32)
        among = x @ x.T
        np.fill_diagonal(among, -np.inf)
        for layer in range(max(self.top, int(level.max())), -1, -1):
            if layer <= self.top:
                beam = BEAM_BUILD if (level >= layer).any() else 1
                found, sims = self._search_layer(x, at, layer, beam)
            else:
                found, sims = np.full((len(batch), 1), -1, np.int32), np.full((len(batch), 1), -np.inf)
            mine = np.flatnonzero(level >= layer)
            if len(mine):
                # those inserted together see each other too
                near = min(M, len(mine) - 1)
                own = among[np.ix_(mine, mine)]
                pick = np.argpartition(-own, near - 1, axis=1)[:, :near] if near > 0 else np.zeros((len(mine), 0), int)
                ids = np.concatenate((found[mine], batch[mine][pick].astype(np.int32)), axis=1)
                s = np.concatenate((sims[mine], np.take_along_axis(own, pick, axis=1)), axis=1)
                chosen = self._diverse(batch[mine], ids, s, M)
                self.layers[layer][batch[mine], : chosen.shape[1]] = chosen
                self._back_links(batch[mine], chosen, layer)
            if layer <= self.top:
                at = found[:, : max(1, min(found.shape[1], 8))]
        if int(level.max()) > self.top:
            self.top, self.entry = int(level.max()), int(batch[level.argmax()])

    def _diverse(self, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates, nearest first, those nearer to the node than to any kept before; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        valid = (ids >= 0) & np.isfinite(sims)
        x = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", x, x)
        rows, width = ids.shape
        kept = np.zeros((rows, width), bool)
        number = np.zeros(rows, int)
        for j in range(width):
            close = (kept & (between[:, j, :] > sims[:, j, None])).any(axis=1)
            take = valid[:, j] & ~close & (number < keep)
            kept[:, j] = take
            number += take
        for j in range(width):  # fill up
            take = valid[:, j] & ~kept[:, j] & (number < keep)
            kept[:, j] |= take
            number += take
        out = np.full((rows, keep), -1, np.int32)
        r, c = np.nonzero(kept)
        slot = (np.cumsum(kept, axis=1) - 1)[r, c]
        out[r, slot] = ids[r, c]
        return out

    def _back_links(self, nodes: np.ndarray, chosen: np.ndarray, layer: int) -> None:
        r, c = np.nonzero(chosen >= 0)
        to, source = chosen[r, c], nodes[r].astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, first, count = np.unique(to, return_index=True, return_counts=True)
        table = self.layers[layer]
        width, most = table.shape[1], 64
        for a in range(0, len(targets), 512):
            t, f, k = targets[a : a + 512], first[a : a + 512], np.minimum(count[a : a + 512], most)
            fresh = np.full((len(t), int(k.max())), -1, np.int32)
            rows = np.repeat(np.arange(len(t)), k)
            columns = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            fresh[rows, columns] = source[np.repeat(f, k) + columns]
            have = table[t]
            fresh[(fresh[:, :, None] == have[:, None, :]).any(axis=2)] = -1
            both = np.concatenate((have, fresh), axis=1)
            free = (both >= 0).sum(axis=1) <= width
            simple = np.flatnonzero(free)
            if len(simple):
                packed = np.take_along_axis(both[simple], np.argsort(both[simple] < 0, axis=1, kind="stable"), axis=1)
                table[t[simple]] = packed[:, :width]
            full = np.flatnonzero(~free)
            if len(full):
                sims = np.einsum("bd,bjd->bj", self.x[t[full]], self.x[np.maximum(both[full], 0)])
                sims[both[full] < 0] = -np.inf
                table[t[full]] = self._diverse(t[full], both[full], sims, width)

    def _search_layer(self, queries: np.ndarray, entries: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of the beam nearest found, nearest first; all queries step together, a few nodes each at a time."""
        q, n = len(queries), len(self.x)
        table = self.layers[layer]
        seen = np.zeros((q, n), bool)
        ids = np.full((q, beam), -1, np.int32)
        sims = np.full((q, beam), -np.inf)
        open_ = np.zeros((q, beam), bool)
        start = entries[:, :beam]
        rows = np.arange(q)[:, None]
        s = np.einsum("qd,qjd->qj", queries, self.x[np.maximum(start, 0)])
        s[start < 0] = -np.inf
        ids[:, : start.shape[1]], sims[:, : start.shape[1]], open_[:, : start.shape[1]] = start, s, start >= 0
        seen[np.broadcast_to(rows, start.shape)[start >= 0], start[start >= 0]] = True
        step = 1 if beam == 1 else 4
        active = np.arange(q)
        while len(active):
            rank = np.where(open_[active], sims[active], -np.inf)
            pick = np.argpartition(-rank, min(step, beam) - 1, axis=1)[:, : min(step, beam)]
            good = np.take_along_axis(rank, pick, axis=1) > -np.inf
            going = good.any(axis=1)
            active, pick, good = active[going], pick[going], good[going]
            if not len(active):
                break
            r = active[:, None]
            open_[np.broadcast_to(r, pick.shape)[good], pick[good]] = False
            nodes = np.where(good, ids[r, pick], -1)
            near = np.where(nodes[:, :, None] >= 0, table[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            fresh = (near >= 0) & ~seen[r, np.maximum(near, 0)]
            fresh_r, fresh_c = np.nonzero(fresh)
            seen[active[fresh_r], near[fresh_r, fresh_c]] = True
            # a node met twice in one step counts once
            if step > 1 and len(fresh_r):
                key = fresh_r.astype(np.int64) * n + near[fresh_r, fresh_c]
                once = np.zeros(len(key), bool)
                once[np.unique(key, return_index=True)[1]] = True
                fresh[fresh_r[~once], fresh_c[~once]] = False
                fresh_r, fresh_c = fresh_r[once], fresh_c[once]
            new = np.full(near.shape, -np.inf)
            new[fresh_r, fresh_c] = np.einsum("kd,kd->k", queries[active[fresh_r]], self.x[near[fresh_r, fresh_c]])
            all_s = np.concatenate((sims[active], new), axis=1)
            all_i = np.concatenate((ids[active], near), axis=1)
            all_o = np.concatenate((open_[active], fresh), axis=1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam] if all_s.shape[1] > beam else np.tile(np.arange(beam), (len(active), 1))
            sims[active], ids[active], open_[active] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1), np.take_along_axis(all_o, top, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full((len(queries), 1), self.entry, np.int32)
        for layer in range(self.top, 0, -1):
            at = self._search_layer(queries, at, layer, 4)[0]
        return self._search_layer(queries, at, 0, beam)


def _beside(x: np.ndarray, cosine: float) -> np.ndarray:
    """Unit vectors that link with some of x: those, turned at random by three quarters of what a link allows."""
    some = x[np.unique(np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int))] if len(x) else x
    aside = np.random.default_rng(len(x)).normal(size=some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    near = cosine + (1 - cosine) / 4
    return np.where(length > 1e-9, near * some + np.sqrt(max(0.0, 1 - near * near)) * aside / np.maximum(length, 1e-9), some)


def close_to(graph: Graph, queries: np.ndarray, cosine: float = COSINE, recall: float = RECALL) -> np.ndarray:
    """Boolean (query, node): cosine reached, as found through the graph.

    A query whose whole beam passes is searched again with a wider one, at the end
    with the whole shard. Then an audit compares some queries with exact search, and
    some made for it: nodes moved by as much as still links, so that there are true
    pairs to miss however few the queries have. Below the wanted recall all are
    searched again with a doubled beam.
    """
    n, asked = len(graph.x), len(queries)
    queries = np.concatenate((queries, _beside(graph.x, cosine)))
    audit = np.concatenate((np.unique(np.linspace(0, asked - 1, min(AUDIT, asked)).astype(int)) if asked else np.zeros(0, int), np.arange(asked, len(queries))))
    truth = queries[audit] @ graph.x.T >= cosine
    beam = BEAM
    while True:
        out = np.zeros((len(queries), n), bool)
        left, width = np.arange(len(queries)), beam
        while len(left):
            again = []
            for a in range(0, len(left), _BATCH):
                mine = left[a : a + _BATCH]
                if width * 4 >= n:  # the beam holds the shard
                    out[mine] = queries[mine] @ graph.x.T >= cosine
                    continue
                ids, sims = graph.search(queries[mine], width)
                hit = (sims >= cosine) & (ids >= 0)
                r, c = np.nonzero(hit)
                out[mine[r], ids[r, c]] = True
                again.append(mine[hit.all(axis=1)])
            left, width = (np.concatenate(again) if again else np.zeros(0, int)), width * 4
        if (out[audit] & truth).sum() >= recall * truth.sum() or beam * 4 >= n:
            return out[:asked]
        beam *= 2


def _spanning(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list, list]:
    """Links (ids) that join what close joins, at most one per node; rows are left, columns right."""
    open_rows, open_columns = np.ones(len(left), bool), np.ones(len(right), bool)
    a, b = [], []
    for seed in range(len(left)):
        if not open_rows[seed]:
            continue
        open_rows[seed] = False
        rows = [seed]
        while rows:
            i = rows.pop()
            new = np.flatnonzero(close[i] & open_columns)
            open_columns[new] = False
            a += [left[i]] * len(new)
            b += right[new].tolist()
            for j in new:
                more = np.flatnonzero(close[:, j] & open_rows)
                open_rows[more] = False
                a += left[more].tolist()
                b += [right[j]] * len(more)
                rows += more.tolist()
    return a, b


def _build(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("class_id")
    x = np.stack([np.asarray(v, np.float64) for v in group["v"]])
    # scaled first, so that squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    graph = Graph(x)
    return pd.DataFrame({
        "label": [group["label"].iloc[0]], "shard": [int(group["shard"].iloc[0])], "ids": [group["class_id"].to_numpy(np.int64).tobytes()], "weights": [group["weight"].to_numpy(np.int64).tobytes()],
        "vectors": [x.tobytes()], "layers": [[t.tobytes() for t in graph.layers]], "entry": [graph.entry], "top": [graph.top],
    })


_SHARD = "label {label}, shard int, ids binary, weights binary, vectors binary, layers array<binary>, entry int, top int"


def _restore(row) -> tuple[np.ndarray, np.ndarray, Graph]:
    ids, weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
    x = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1)
    layers = [np.frombuffer(t, np.int32).reshape(len(ids), -1) for t in row["layers"]]
    return ids, weights, Graph.restore(x, layers, int(row["entry"]), int(row["top"]))


def _sums(close: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row, the weights of the columns that are set."""
    rows, columns = np.nonzero(close)
    return np.bincount(rows, weights[columns], len(close)).astype(np.int64)


def _match(cosine: float):
    """Over the shards of two tiles: every pair of a shard of the first with one of the second, or within one tile each pair once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        frames = []
        shards = {int(r["shard"]): _restore(r) for _, r in group.iterrows()}
        i, j = int(group["i"].iloc[0]), int(group["j"].iloc[0])
        of_tile = {t: sorted(int(r["shard"]) for _, r in group.iterrows() if r["tile"] == t) for t in (i, j)}
        for left, right in [(a, b) for a in of_tile[i] for b in of_tile[j] if i != j or a <= b]:
            ids, weights, graph = shards[left]
            if left == right:
                close = close_to(graph, graph.x, cosine)
                close |= close.T
                np.fill_diagonal(close, True)
                n = _sums(close, weights) - 1  # all others, its own copies included
                a, b = _spanning(close, ids, ids)
                frames.append(pd.DataFrame({"kind": 0, "a": ids, "b": n}))
            else:
                other, their, second = shards[right]
                close = close_to(second, graph.x, cosine) | close_to(graph, second.x, cosine).T
                a, b = _spanning(close, ids, other)
                frames.append(pd.DataFrame({"kind": 0, "a": np.concatenate((ids, other)), "b": np.concatenate((_sums(close, their), _sums(close.T, weights)))}))
            frames.append(pd.DataFrame({"kind": 1, "a": np.array(a, np.int64), "b": np.array(b, np.int64)}))
        return pd.concat(frames)

    return run


def embedding_dedup(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, shard_rows: int = SHARD) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Only rows of the same label, not null, are compared. A vector that is null,
    empty or all zero, or holds a null or a component that is not finite, links
    with nothing, and so does a row without label or id; it is its own component.
    Vectors of different length do not link. Rows that repeat an id, with vectors
    that differ, are one name: their links are summed and their components joined.
    Links are symmetric. Recall against exact search is audited in every search
    and at least RECALL there. An empty table gives no rows; other columns, of any
    name, are not looked at.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("v").isNotNull()
    usable &= ~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # lengths differ: a part of the label
    good = rows.where("usable").withColumn("label", F.struct("label", F.size("v").alias("d")).cast("struct<label:string,d:int>")).withColumn("label", F.concat_ws("/", F.col("label.d").cast("string"), F.col("label.label")))
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    classes = scratch.keep(classes, "classes")
    shards = classes.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("shards"))
    dealt = classes.join(shards, "label").withColumn("shard", F.pmod(F.xxhash64("class_id", "v"), F.col("shards")).cast("int"))
    built = scratch.keep(dealt.select("label", "shard", "class_id", "weight", "v").groupBy("label", "shard").applyInPandas(_build, _SHARD.format(label="string")), "graphs")
    # a shard goes once to each pair of tiles that its own is in, not to each pair of shards; few shards are tiles of one
    tile = F.floor(F.col("shard") / F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.col("shards") / TILE)))).cast("int")
    tiled = built.join(shards, "label").withColumn("tile", tile)
    last = tiled.groupBy("label").agg(F.max("tile").alias("last"))
    sent = tiled.join(last, "label").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).withColumn("i", F.least("tile", "other")).withColumn("j", F.greatest("tile", "other"))
    found = sent.drop("shards", "last", "other").groupBy("label", "i", "j").applyInPandas(_match(cosine), "kind int, a long, b long")
    found = scratch.keep(found, "matches")
    links = components(found.where("kind = 1").select("a", "b"))
    by_class = found.where("kind = 0").groupBy(F.col("a").alias("class_id")).agg(F.sum("b").alias("n_links"))
    placed = by_class.join(links, by_class.class_id == links.node, "left").select("class_id", "n_links", F.coalesce("root", "class_id").alias("component_id"))
    members = good.select("vec_id", "label", "v").join(classes.select("label", "v", "class_id"), ["label", "v"]).select("vec_id", "class_id")
    linked = members.join(placed, "class_id").select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
