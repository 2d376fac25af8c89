"""Near-duplicate vectors: hierarchical navigable small-world graphs, one a shard.

Equal vectors form one class. Classes are dealt into shards of bounded size; each shard's graph is
built once and filed, and every class of its dimension queries it. A search descends the layers
greedily and widens a beam on the lowest one. Widths grow in two ways: a query that finds links is
repeated until its beam is over twice as wide as what it found, and each shard audits its first width
and doubles it until the recall passes. The audit holds planted copies of rows, turned until their
cosine is the threshold, of which there are always as many as rows, up to PLANTED, and the true links of
a sample of rows to others, by brute force; a row's own entry never counts. Where the audit fails and a
wider beam would cost more than that, the shard compares its queries exactly, in blocks: no shard goes
on without a passed audit. Found pairs are verified by their cosine in double precision.

A query task joins the links it found by union-find and emits only a spanning forest of them
and each query's number of links, so a large group costs its size, not its square; the forests'
components are found by ``connected_components``.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing and are kept, as are null ids (with a null component); vectors of different dimensions don't
link; vectors are what links, ids only name them: rows of one id with different vectors have the
links and components of their own; a component's smallest id is no tie; repeated rows give one row
each and count as that many vectors; very long vectors make smaller shards; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, staged
from .shards import Layout, ask, build, is_usable, matrix, usable

LINKS, LINKS_BASE, BUILD_WIDTH, FIRST_WIDTH = 8, 16, 24, 12
BATCH, SEED = 256, 3
AUDITED, PLANTED, RECALL = 256, 512, 0.99
NEAR = 1e-4
#: A place in the beam takes a query about as long as this many rows compared exactly.
PLACE_ROWS = 1000


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.int64).view(np.uint64) + np.uint64(SEED)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def beam(near: np.ndarray, x: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of every query at once: the ``width`` best rows found and their similarities."""
    n, b = len(near), len(q)
    width = min(width, n)
    seen = np.zeros((b, n), bool)
    ids, sims, open_ = np.full((b, width), -1, np.int64), np.full((b, width), -2.0, np.float32), np.zeros((b, width), bool)
    rows = np.arange(b)
    ids[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("bd,bd->b", x[entry], q), True
    seen[rows, entry] = True
    live = rows
    while len(live):
        score = np.where(open_[live], sims[live], -3.0)
        at = score.argmax(axis=1)
        more = score[np.arange(len(live)), at] > -3.0
        live, at = live[more], at[more]
        if not len(live):
            break
        open_[live, at] = False
        to = near[ids[live, at]]
        fresh = (to >= 0) & ~seen[live[:, None], to]
        r, c = np.nonzero(fresh)
        seen[live[r], to[r, c]] = True
        got = np.full(to.shape, -2.0, np.float32)
        got[r, c] = np.einsum("ed,ed->e", x[to[r, c]], q[live[r]])
        all_sims = np.concatenate([sims[live], got], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live] = np.take_along_axis(all_sims, keep, 1)
        ids[live] = np.take_along_axis(np.concatenate([ids[live], to], axis=1), keep, 1)
        open_[live] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), keep, 1)
    ids[sims <= -2.0] = -1
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Each row's neighbours: candidates nearer to it than to any nearer neighbour, then the rest."""
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    v = x[np.maximum(cand, 0)]
    mutual = np.einsum("bcd,bed->bce", v, v)
    kept = np.zeros(cand.shape, bool)
    for c in range(cand.shape[1]):
        crowded = (kept & (mutual[:, c] > sims[:, c : c + 1])).any(axis=1)
        kept[:, c] = (cand[:, c] >= 0) & ~crowded & (kept.sum(axis=1) < links)
    rank = np.where(kept, 0, np.where(cand >= 0, 1, 2))
    first = np.argsort(rank, axis=1, kind="stable")[:, :links]
    out = np.take_along_axis(cand, first, 1)
    if out.shape[1] < links:
        out = np.pad(out, ((0, 0), (0, links - out.shape[1])), constant_values=-1)
    return out


class Graph:
    """Layers over one order of the rows, highest first; layer l holds a prefix of it."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray):
        mixed = _mixed(ids)
        level = np.minimum(8, (-np.log((mixed >> np.uint64(11)).astype(float) / 2**53 + 1e-18) / np.log(LINKS_BASE)).astype(int))
        self.order = np.lexsort((mixed, -level))
        self.x = unit[self.order].astype(np.float32)
        sizes = [int((level >= l).sum()) for l in range(int(level.max()) + 1)]
        self.layers: list[np.ndarray] = []
        for l in range(len(sizes) - 1, -1, -1):
            self._add_layer(sizes[l], LINKS if l else LINKS_BASE)
        self._connect()

    def arrays(self) -> dict[str, np.ndarray]:
        """What ``loaded`` needs beside the unit rows."""
        return {"order": self.order, **{f"layer{i}": near.astype(np.int32) for i, near in enumerate(self.layers)}}

    @classmethod
    def loaded(cls, arrays: dict, unit: np.ndarray) -> Graph:
        out = cls.__new__(cls)
        out.order = arrays["order"]
        out.x = unit[out.order].astype(np.float32)
        out.layers = [arrays[f"layer{i}"].astype(np.int64) for i in range(sum(k.startswith("layer") for k in arrays))]
        return out

    def _connect(self) -> None:
        """Give the nearest reachable row with a free place a link to each part that can't be reached."""
        near = np.concatenate([self.layers[-1], np.full((len(self.x), 1), -1, np.int64)], axis=1)
        reached = np.zeros(len(near), bool)
        start = 0
        while True:
            reached[start], front = True, np.array([start])
            while len(front):
                front = np.unique(near[front])
                front = front[front >= 0]
                front = front[~reached[front]]
                reached[front] = True
            if reached.all():
                break
            start = int(np.flatnonzero(~reached)[0])
            sims = self.x @ self.x[start]
            sims[~reached | (near[:, -1] >= 0)] = -3.0
            near[int(sims.argmax()), -1] = start
        self.layers[-1] = near

    def _entry(self, q: np.ndarray) -> np.ndarray:
        at = np.zeros(len(q), np.int64)
        for near in self.layers:
            at = beam(near, self.x, q, at, 2)[0][:, 0]
        return at

    def _add_layer(self, n: int, links: int) -> None:
        near, done = np.full((n, links), -1, np.int64), 1
        while done < n:
            end = min(n, done + min(done, BATCH))
            q = self.x[done:end]
            entry = self._entry(q)
            cand, sims = beam(near[:done], self.x, q, np.where(entry < done, entry, 0), BUILD_WIDTH)
            mates = q @ q.T
            np.fill_diagonal(mates, -2.0)
            best = np.argsort(-mates, axis=1)[:, : min(LINKS, len(q) - 1)]
            cand, sims = np.concatenate([cand, best + done], axis=1), np.concatenate([sims, np.take_along_axis(mates, best, 1)], axis=1)
            near[done:end] = choose(self.x, cand, sims, links)
            self._link_back(near, done, end, links)
            done = end
        self.layers.append(near)

    def _link_back(self, near: np.ndarray, start: int, end: int, links: int) -> None:
        """The new rows' neighbours choose anew among their own neighbours and the new rows."""
        r, c = np.nonzero(near[start:end] >= 0)
        to, new = near[start:end][r, c], r + start
        sim = np.einsum("ed,ed->e", self.x[to], self.x[new])
        by = np.lexsort((-sim, to))
        to, new = to[by], new[by]
        targets, first = np.unique(to, return_index=True)
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        add = np.full((len(targets), links), -1, np.int64)
        ok = place < links
        add[np.searchsorted(targets, to[ok]), place[ok]] = new[ok]
        add[(add[:, :, None] == near[targets][:, None, :]).any(axis=2)] = -1
        cand = np.concatenate([near[targets], add], axis=1)
        sims = np.einsum("bcd,bd->bc", self.x[np.maximum(cand, 0)], self.x[targets])
        near[targets] = choose(self.x, cand, np.where(cand >= 0, sims, -2.0), links)

    def within(self, q: np.ndarray, least: float, width: int) -> list[np.ndarray]:
        """Rows (in the given order) at least ``least`` similar to each unit query, as far as the beam finds them."""
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(q)
        todo, q = np.arange(len(q)), q.astype(np.float32)
        while len(todo):
            wide = []
            step = max(1, min(512, (1 << 24) // len(self.x), (1 << 21) // width))
            for i in range(0, len(todo), step):
                part = todo[i : i + step]
                ids, sims = beam(self.layers[-1], self.x, q[part], self._entry(q[part]), width)
                near = sims >= least - NEAR
                hits = near.sum(axis=1)
                wide += part[(hits > 0) & (width < 2 * hits + 8) & (ids.shape[1] < len(self.x))].tolist()
                r, c = np.nonzero(near)
                for j, found in zip(part, np.split(self.order[ids[r, c]], np.searchsorted(r, np.arange(1, len(part)))), strict=True):
                    out[j] = found
            todo, width = np.array(wide, np.int64), 4 * width
        return out


def planted(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and a copy of each, turned in a random direction until the cosine is ``least``."""
    rng = np.random.default_rng(SEED)
    rows = rng.permutation(len(x))[:PLANTED]
    base, cos = x[rows], min(1.0, least + NEAR / 100)
    aside = rng.normal(size=base.shape)
    aside -= np.einsum("bd,bd->b", aside, base)[:, None] * base
    aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    copies = cos * base + np.sqrt(1 - cos * cos) * aside
    return rows, copies / np.linalg.norm(copies, axis=1, keepdims=True)


class Audit:
    """The links a shard's search must find: of planted copies, and of a sample of rows to other rows."""

    def __init__(self, x: np.ndarray, least: float):
        self.least, self.n = least, len(x)
        rows, copies = planted(x, least)
        sample = np.random.default_rng(SEED).permutation(len(x))[:AUDITED]
        near = [np.flatnonzero(x @ x[i] >= least) for i in sample]
        own = [t[t != i] for i, t in zip(sample, near, strict=True)]
        self.queries = np.concatenate([copies, x[sample]])
        self.wanted = [np.array([r]) for r in rows] + own
        self.links = sum(map(len, self.wanted))

    def recall(self, graph: Graph, width: int) -> float:
        hits = sum(np.isin(w, f).sum() for w, f in zip(self.wanted, graph.within(self.queries, self.least, width), strict=True))
        return float(hits / self.links)

    def width(self, graph: Graph) -> tuple[int, float]:
        """The first width that passes and its recall, or 0 and 1 where comparing exactly is cheaper."""
        width = FIRST_WIDTH
        while True:
            found = self.recall(graph, width)
            if found >= RECALL:
                return width, found
            width *= 2
            if width * PLACE_ROWS > self.n:
                return 0, 1.0


def exact_within(x: np.ndarray, q: np.ndarray, least: float):
    """Rows at least ``least`` similar to each unit query, all of them, a block of queries at a time."""
    base, step = x.astype(np.float32), max(1, (1 << 24) // len(x))
    for i in range(0, len(q), step):
        r, c = np.nonzero(q[i : i + step].astype(np.float32) @ base.T >= least - NEAR)
        yield from np.split(c, np.searchsorted(r, np.arange(1, len(q[i : i + step]))))


def unit_rows(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def shard_index(group: pd.DataFrame, least: float) -> dict[str, np.ndarray]:
    """A shard's rows (row, w, v), graph and audited width."""
    ids, x = group["row"].to_numpy(), unit_rows(matrix(group["v"]))
    graph, audit = Graph(ids, x), Audit(x, least)
    width, recall = audit.width(graph)
    return {"ids": ids, "w": group["w"].to_numpy(), "x": x, **graph.arrays(), "size": np.array(len(ids)), "width": np.array(width), "audited": np.array(audit.links), "recall": np.array(recall)}


def shard_links(arrays: dict, batches, least: float):
    """Rows (row, n) of each query's links in this shard, and rows (a, b) of a spanning forest."""
    ids, weight, x, width = arrays["ids"], arrays["w"], arrays["x"], int(arrays["width"])
    graph = Graph.loaded(arrays, x) if width else None
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while parent.setdefault(i, i) != i:
            parent[i] = i = parent[parent[i]]
        return i

    for batch in batches:
        qids, q = batch["row"].to_numpy(), unit_rows(matrix(batch["v"]))
        counts, forest = [], []
        for i, near in enumerate(graph.within(q, least, width) if width else exact_within(x, q, least)):
            near = near[(x[near] @ q[i] >= least) & (ids[near] != qids[i])] if len(near) else near
            if len(near):
                counts.append((int(qids[i]), int(weight[near].sum())))
                for other in ids[near].tolist():
                    a, b = root(int(qids[i])), root(other)
                    if a != b:
                        parent[max(a, b)] = min(a, b)
                        forest.append((int(qids[i]), other))
        # whole numbers from both kinds of row: a link's ends, or a query and its count
        yield pd.DataFrame([(True, i, n) for i, n in counts] + [(False, a, b) for a, b in forest], columns=["count", "a", "b"]).astype({"count": "bool", "a": "int64", "b": "int64"})


def found_links(classes: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(count, a, b): a forest's links, or rows and their numbers of links in a shard; and
    (shard, size, width, audited, recall) of each shard, width 0 where all were compared."""
    layout, spark = Layout(classes), classes.sparkSession
    report = "size long, width long, audited long, recall double"
    if not layout.total:
        return spark.createDataFrame([], "count boolean, a long, b long"), spark.createDataFrame([], f"shard long, {report}")
    root, reports = build(classes.select("row", "w", "v"), layout, "row", lambda g: shard_index(g, least), report)
    found = ask(classes.select("row", "v"), layout, "row", classes.count(), root, lambda arrays, batches: shard_links(arrays, batches, least), "count boolean, a long, b long")
    return staged(found, "vector-links"), reports


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    prints = [F.xxhash64(F.lit(i), "v").alias(f"h{i}") for i in (1, 2)]  # 128 bits of the vector
    rows = staged(usable(vectors, id_col, vec_col).select("id", "v", *prints, F.monotonically_increasing_id().alias("row")), "vectors")
    classes = staged(rows.groupBy("h1", "h2").agg(F.min("row").alias("row"), F.min("id").alias("id"), F.count("*").alias("w"), F.any_value("v").alias("v")), "vector-classes")
    found, _ = found_links(classes, least)
    comps = connected_components(found.where("not count").select("a", "b")).withColumnRenamed("id", "row")
    links = found.where("count").groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("n"))
    first = classes.select("row", "id").join(comps, "row").groupBy("component").agg(F.min("id").alias("first"))
    named = classes.drop("v").join(links, "row", "left").join(comps.join(first, "component"), "row", "left")
    named = named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("first", "id").alias("component_id"))
    linked = rows.select("id", "h1", "h2").join(named, ["h1", "h2"]).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    lone = vectors.where(~is_usable(id_col, vec_col)).select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(id_col).cast("long").alias("component_id"))
    return linked.unionAll(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
