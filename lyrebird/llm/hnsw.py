"""Near-duplicate vectors by hierarchical navigable small-world graphs, one for each shard.

Vectors are compared within a group: equal label and equal length. Equal vectors of a group are one node
with a number of copies. The nodes of a group are hashed into shards of about ``shard_size``; each shard
gets a graph. Every vector is searched for in its own shard's graph and in that of every shard before it,
so that each pair of vectors meets in exactly one search and no link can be counted twice. Shards go to the
graphs that they are searched in as queries, ``ABREAST`` shards to a task, beside one graph: a graph of n nodes
moves once for so many shards, and a group of N vectors moves N * N / (2 * n) queries in all.

A search follows beams through the graph, many queries abreast. Its beam widens by rungs: a query goes on to
the next rung while all of its beam is within the threshold, and all queries of a search go on while a
recall audit stays below ``recall``. The audit has two parts, and both must pass. Evenly spaced queries are
compared with the whole shard, and the search must find the links that they have. Links can be rare, so ``PROBES``
links are planted: nodes turned by just the threshold's angle into a random direction are searched for, and each must
find its node. Self matches are no evidence. What no rung can answer is compared with the whole shard, which
is bounded. Links are kept at a cosine, in double precision, of the threshold or more.

A search returns one row for each node that has links in it: how many vectors it links to there and the
least node connected to it there. So a clique of copies costs a row for each member, not for each pair.

Defined cases: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is
null, links with nothing; components of any finite size are compared as they are, without overflow; repeated rows are
vectors of their own that link with each other; a row with a null id takes part and has no component of its own name;
empty tables give empty results. Only the three columns named are read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import settle, ship
from .components import components

SHARD, M, BUILD_BEAM = 16_384, 12, 48
#: Shards of queries that meet one graph in a task.
ABREAST = 8
#: Beams of the rungs before the last, which is the whole shard.
RUNGS = (48, 160, 640)
#: Queries that are compared with the whole shard, and links that are planted, for the audit of a search.
AUDITED, PROBES = 96, 128
#: Width of a beam for each node that is opened at a time; queries that are searched for abreast.
STRIDE, QUERIES = 80, 512


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    # Scaled first, so that squares of very small and very large components neither vanish nor overflow.
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Graph:
    """layers[h]: neighbours of each node at height h, -1 where there is none; nodes below a height have none there."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x
        n = len(x)
        heights = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        self.layers = [np.full((n, 2 * M if h == 0 else M), -1, np.int32) for h in range(int(heights.max()) + 1)]
        self.entry = int(np.argmax(heights))
        order = np.concatenate([[self.entry], np.delete(np.arange(n), self.entry)])
        self.heights = heights
        done = 1
        while done < n:
            size = min(256, max(8, done), n - done)
            self._insert(order[done : done + size])
            done += size

    def _insert(self, new: np.ndarray) -> None:
        q = self.x[new]
        near = np.full((len(new), 1), self.entry)
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        for h in range(len(self.layers) - 1, -1, -1):
            ids, sims = self.beam(q, near, BUILD_BEAM if (self.heights[new] >= h).any() else 1, h)
            near = ids
            here = np.flatnonzero(self.heights[new] >= h)
            if not len(here):
                continue
            # Those inserted together are candidates for each other beside what the beam has found.
            peers = among[np.ix_(here, here)]
            take = min(M, len(here) - 1)
            if take > 0:
                best = np.argpartition(-peers, take - 1, axis=1)[:, :take]
                ids_h = np.concatenate([ids[here], new[here][best]], 1)
                sims_h = np.concatenate([sims[here], np.take_along_axis(peers, best, 1)], 1)
            else:
                ids_h, sims_h = ids[here], sims[here]
            width = self.layers[h].shape[1]
            chosen = self._diverse(ids_h, sims_h, M)
            self.layers[h][new[here], : chosen.shape[1]] = chosen
            self._back(h, new[here], chosen, width)

    def _back(self, h: int, sources: np.ndarray, chosen: np.ndarray, width: int) -> None:
        """Edges from the chosen neighbours back to the new nodes; a full list is chosen anew."""
        to, frm = chosen.ravel(), np.repeat(sources, chosen.shape[1])
        on = to >= 0
        order = np.argsort(to[on], kind="stable")
        to, frm = to[on][order], frm[on][order]
        if not len(to):
            return
        nodes, first, counts = np.unique(to, return_index=True, return_counts=True)
        extra = np.full((len(nodes), int(counts.max())), -1)
        extra[np.repeat(np.arange(len(nodes)), counts), np.arange(len(to)) - np.repeat(first, counts)] = frm
        ids = np.concatenate([self.layers[h][nodes], extra], 1)
        for at in range(0, len(nodes), 1024):
            rows, some = nodes[at : at + 1024], ids[at : at + 1024]
            sims = np.einsum("nkd,nd->nk", self.x[some], self.x[rows])
            sims[some < 0] = -np.inf
            keep = min(some.shape[1], 4 * M)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :keep]
            got = self._diverse(np.take_along_axis(some, best, 1), np.take_along_axis(sims, best, 1), width)
            self.layers[h][rows] = -1
            self.layers[h][rows, : got.shape[1]] = got

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, want: int) -> np.ndarray:
        """Of each row's candidates those that are nearer to the row than to any chosen before; then the nearest others."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        dup = np.zeros(ids.shape, bool)
        for k in range(1, ids.shape[1]):
            dup[:, k] = (ids[:, :k] == ids[:, k : k + 1]).any(1)
        sims = np.where(dup | (ids < 0), -np.inf, sims)
        vectors = self.x[ids]
        picked, count = np.zeros(ids.shape, bool), np.zeros(len(ids), int)
        nearest = np.full(ids.shape, -np.inf)
        for k in range(ids.shape[1]):
            add = (sims[:, k] > nearest[:, k]) & (count < want) & np.isfinite(sims[:, k])
            if add.any():
                rows = np.flatnonzero(add)
                picked[rows, k] = True
                count[rows] += 1
                near = np.einsum("nkd,nd->nk", vectors[rows], vectors[rows, k])
                nearest[rows] = np.maximum(nearest[rows], near)
        rank = np.where(picked, 0, np.where(np.isfinite(sims), 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :want]
        return np.where(np.isfinite(np.take_along_axis(sims, best, 1)), np.take_along_axis(ids, best, 1), -1)

    def beam(self, q: np.ndarray, start: np.ndarray, width: int, h: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes that a beam from ``start`` meets for each row of q, nearest first; -1 for none. Of a
        wide beam several nodes are opened at a time."""
        n, rows = len(self.x), np.arange(len(q))
        width = max(1, min(width, n))
        at_once = max(1, width // STRIDE)
        seen = np.zeros((len(q), n + 1), bool)  # the last column stands for no node
        seen[:, n] = True
        ids = np.full((len(q), width + at_once * self.layers[h].shape[1]), n)
        sims = np.full(ids.shape, -np.inf)
        start = np.where(start < 0, n, start)[:, :width]
        for k in range(start.shape[1]):
            fresh = ~seen[rows, start[:, k]]
            ids[fresh, k] = start[fresh, k]
            seen[rows, start[:, k]] = True
        held = ids[:, : start.shape[1]]
        sims[:, : start.shape[1]] = np.where(
            held < n, np.einsum("nkd,nd->nk", self.x[np.minimum(held, n - 1)], q), -np.inf,
        )
        opened = np.zeros(ids.shape, bool)
        live = rows
        while len(live):
            top = np.where(opened[live, :width], -np.inf, sims[live, :width])
            if at_once == 1:
                pick = top.argmax(1)[:, None]
            else:
                pick = np.argpartition(-top, at_once - 1, axis=1)[:, :at_once]
            real = np.isfinite(np.take_along_axis(top, pick, 1))
            on = real.any(1)
            live, pick, real = live[on], pick[on], real[on]
            if not len(live):
                break
            # Where fewer than that are left, nodes that were opened before come again and bring nothing fresh.
            opened[live[:, None], pick] = True
            nb = self.layers[h][np.where(real, ids[live[:, None], pick], 0)].astype(np.int64)
            nb[~real | (nb < 0).all(2)] = n
            nb = nb.reshape(len(live), -1)
            nb[nb < 0] = n
            if at_once > 1:
                nb.sort(axis=1)
                nb[:, 1:][nb[:, 1:] == nb[:, :-1]] = n
            fresh = ~seen[live[:, None], nb]
            seen[live[:, None], nb] = True
            nb = np.where(fresh, nb, n)
            got = np.einsum("nkd,nd->nk", self.x[np.minimum(nb, n - 1)], q[live])
            got[nb == n] = -np.inf
            some = np.flatnonzero((got > sims[live, :width].min(1)[:, None]).any(1))
            at = live[some]
            ids[at, width:], sims[at, width:], opened[at, width:] = nb[some], got[some], False
            best = np.argpartition(-sims[at], width - 1, axis=1) if width < ids.shape[1] else np.argsort(-sims[at], axis=1)
            ids[at], sims[at], opened[at] = np.take_along_axis(ids[at], best, 1), np.take_along_axis(sims[at], best, 1), np.take_along_axis(opened[at], best, 1)
        order = np.argsort(-sims[:, :width], axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids[:, :width], order, 1), np.take_along_axis(sims[:, :width], order, 1)
        return np.where(np.isfinite(sims), ids, -1), sims

    def nearest(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.full((len(q), 1), self.entry)
        for h in range(len(self.layers) - 1, 0, -1):
            near, _ = self.beam(q, near, 1, h)
        return self.beam(q, near, width, 0)


def _probes(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Evenly spaced nodes, and each turned by the threshold's angle into a direction of its own."""
    nodes = np.unique(np.linspace(0, len(x) - 1, min(len(x), PROBES)).astype(int))
    if x.shape[1] < 2:
        return nodes, x[nodes]
    aside = np.random.default_rng(11).normal(size=(len(nodes), x.shape[1]))
    aside -= (aside * x[nodes]).sum(1, keepdims=True) * x[nodes]
    aside /= np.sqrt((aside * aside).sum(1, keepdims=True))
    cosine = min(1.0, threshold + 1e-9)
    return nodes, cosine * x[nodes] + np.sqrt(1 - cosine * cosine) * aside


def links(
    graph: Graph, q: np.ndarray, threshold: float, recall: float, rungs: tuple[int, ...] = RUNGS, own: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, node): all pairs found with a cosine of the threshold or more; own says that q are the nodes themselves."""
    audit = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDITED)).astype(int))
    near = q[audit] @ graph.x.T >= threshold
    if own:
        near[np.arange(len(audit)), audit] = False
    true = near.sum(1)
    planted, probes = _probes(graph.x, threshold)
    found_a, found_b, todo = [], [], np.arange(len(q))
    for width in rungs:
        if not len(todo):
            break
        ids, _ = graph.nearest(probes, width)
        if (ids == planted[:, None]).any(1).sum() < recall * len(planted):
            continue
        left, hits = [], np.zeros(len(q), int)
        part_a, part_b = [], []
        abreast = max(32, QUERIES // max(1, width // STRIDE))
        for at in range(0, len(todo), abreast):
            rows = todo[at : at + abreast]
            ids, sims = graph.nearest(q[rows], width)
            good = (sims >= threshold) & (ids >= 0)
            hits[rows] = (good & (ids != rows[:, None]) if own else good).sum(1)
            full = good.all(1)
            left.append(rows[full])
            r, k = np.nonzero(good & ~full[:, None])
            part_a.append(rows[r]), part_b.append(ids[r, k])
        wider = np.concatenate(left)
        # The audit is over the audited queries that end on this rung.
        ended = np.isin(audit, np.setdiff1d(todo, wider))
        if hits[audit[ended]].sum() < recall * true[ended].sum():
            continue
        found_a += part_a
        found_b += part_b
        todo = wider
    for at in range(0, len(todo), 256):
        rows = todo[at : at + 256]
        r, k = np.nonzero(q[rows] @ graph.x.T >= threshold)
        found_a.append(rows[r]), found_b.append(k)
    join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return join(found_a), join(found_b)


def _least(a: np.ndarray, b: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each node the least name connected to it by the pairs (a, b)."""
    root = names.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            return root
        root = new


SHARDS = "dim int, shard int, shards int, raw binary, nodes binary, copies binary, graph binary"


def _build(group: pa.Table, kind: str) -> pa.Table:
    """One row for a shard: its vectors, their names and copies, and the graph."""
    raw = np.array(group.column("v").to_pylist(), kind)
    graph = Graph(_unit(raw))
    row = {c: group.column(c)[0].as_py() for c in ("dim", "shard", "shards")}
    row |= {
        "raw": raw.tobytes(), "nodes": group.column("node").to_numpy().tobytes(),
        "copies": group.column("n").to_numpy().tobytes(),
    }
    row["graph"] = pickle.dumps((graph.layers, graph.entry))
    kinds = [*[pa.int32()] * 3, *[pa.binary()] * 4]
    return pa.table(
        {"label": group.column("label").slice(0, 1), **{c: pa.array([v], k) for (c, v), k in zip(row.items(), kinds)}}
    )


def _search(held: pa.Table, asked: pa.Table, kind: str, threshold: float, recall: float) -> pa.Table:
    """Links between the nodes of one graph and those of some shards."""
    out = []
    side = held.to_pylist()[0] if held.num_rows else None
    for i in range(asked.num_rows if side else 0):
        row = asked.slice(i, 1).to_pylist()[0]
        read = lambda r, c, k: np.frombuffer(r[c], k)
        x, q = (_unit(read(r, "raw", kind).reshape(-1, r["dim"])) for r in (side, row))
        graph = Graph.__new__(Graph)
        graph.x = x
        graph.layers, graph.entry = pickle.loads(side["graph"])
        own = row["from"] == side["shard"]
        a, b = links(graph, q, threshold, recall, own=own)
        names, weights = read(side, "nodes", np.int64), read(side, "copies", np.int64)
        if own:
            # Both directions were searched: take each pair once.
            a, b = np.divmod(np.unique(np.minimum(a, b)[a != b] * len(x) + np.maximum(a, b)[a != b]), len(x))
        else:
            names, weights = np.concatenate([names, read(row, "nodes", np.int64)]), np.concatenate(
                [weights, read(row, "copies", np.int64)]
            )
            a = a + len(x)
        count = np.bincount(a, weights[b], len(names)) + np.bincount(b, weights[a], len(names))
        on = np.flatnonzero(count)
        out.append((names[on], count[on].astype(np.int64), _least(a, b, names)[on]))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table(dict(zip(("node", "links", "root"), columns)))


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = 0.99, shard_size: int = SHARD
) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row."""
    spark = rows.sparkSession
    ship(spark)
    # Floats stay floats on their way and are widened for the arithmetic; all other numbers are doubles.
    element = rows.schema[vector_col].dataType
    kind = "float" if isinstance(element, ArrayType) and isinstance(element.elementType, FloatType) else "double"
    dtype = {"float": "float32", "double": "float64"}[kind]
    top = float("inf")
    usable = F.forall("v", lambda x: x.isNotNull() & (x < top) & (x > -top)) & F.exists("v", lambda x: x != 0)
    given = rows.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.col(label_col).alias("label"),
    )
    given = given.withColumn("good", F.coalesce(F.col("label").isNotNull() & usable, F.lit(False)))
    nodes = settle(
        given.where("good").groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("n"))
        .select("label", F.size("v").alias("dim"), "v", "least", "n", F.monotonically_increasing_id().alias("node"))
    )
    groups = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard_size).cast("int").alias("shards"))
    dealt = nodes.drop("least").join(groups, ["label", "dim"]).withColumn(
        "shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"),
    )
    label = nodes.schema["label"].dataType.simpleString()
    graphs = settle(
        dealt.groupBy("label", "dim", "shard").applyInArrow(
            lambda group: _build(group, dtype), f"label {label}, {SHARDS}"
        )
    )
    # Shard s is asked about in the graphs 0 to s; so the graph g meets the shards from g on, some at a time.
    task_of = lambda c: F.floor(c / ABREAST).cast("int")
    held = graphs.withColumn("task", F.explode(F.sequence(task_of(F.col("shard")), task_of(F.col("shards") - 1))))
    asked = graphs.drop("graph").withColumnRenamed("shard", "from").withColumns(
        {"shard": F.explode(F.sequence(F.lit(0), "from")), "task": task_of(F.col("from"))}
    )
    met = ["label", "dim", "shard", "task"]
    searched = held.groupBy(*met).cogroup(asked.groupBy(*met)).applyInArrow(
        lambda a, b: _search(a, b, dtype, threshold, recall), "node long, links long, root long"
    )
    found = settle(searched)
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.join(linked, "node", "left").join(roots, "node", "left").select(
        "label", "v", "least", "n", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("root", "node").alias("root"),
    )
    named = settle(named)
    best = named.groupBy("root").agg(F.min("least").alias("component"))
    lookup = named.join(best, "root").select(
        "label", "v", (F.col("links") + F.col("n") - 1).alias("n_links"), "component",
    )
    out = given.where("good").join(lookup, ["label", "v"]).select(
        "id", "n_links", F.col("component").alias("component_id"),
    )
    alone = given.where(~F.col("good")).select(
        "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"),
    )
    return out.union(alone).select(
        F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
