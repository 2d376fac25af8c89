"""Approximate nearest neighbours by cross-polytope hashing.

Three rounds of random signs and a fast Hadamard transform rotate a unit vector; the signed axis
nearest to it (the largest coordinate and its sign) is its hash. TABLES rotations index every
vector; a query probes the PROBES nearest axes of each table. The vectors that it meets in enough
of the tables are its candidates, which are reranked by their exact inner product.

How many tables are enough is fitted a shard: the most with which AUDITED of its rows, as queries,
still find RECALL of their nearest rows (twice a shard's part of k), compared with all rows exactly.
That sample is the only one; every row is indexed. In a larger shard neighbours are nearer, so more meetings can be asked
for and a smaller share is reranked. A query with fewer candidates than k in a shard is compared
with all its rows, so it gets k rows whenever there are k others, and so is any query in a shard of
no more rows than a query has probes.

For the largest inner product, vectors are lifted onto a common sphere (one more coordinate, after
division by a shard's largest norm) unless all are of one length, queries with a zero there, so
that the nearest direction is the largest product. The base is dealt into shards of bounded size,
whose index is built once; every shard answers all queries of its dimension, and the best merge by
rank. Nothing is capped but the k of the result.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those
of null ids, neither ask nor answer; vectors of different dimensions don't meet; a query doesn't
find its own row, nor others of its id; ties go to the smaller id; with at most k candidates all
rows are returned; equal vectors are separate candidates; very long vectors make smaller shards; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .shards import Layout, ask, build, matrix, usable

TABLES, PROBES, SEED = 64, 8, 5
AUDITED, RECALL = 96, 0.97
FOUND = "query_id long, vec_id long, score double, ranked long"


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, whose number of columns is a power of two."""
    x, y, h = x.copy(), np.empty_like(x), 1
    while h < x.shape[1]:
        a, b = x.reshape(len(x), -1, 2, h), y.reshape(len(x), -1, 2, h)
        np.add(a[:, :, 0], a[:, :, 1], out=b[:, :, 0])
        np.subtract(a[:, :, 0], a[:, :, 1], out=b[:, :, 1])
        x, y, h = y, x, 2 * h
    return x / x.dtype.type(np.sqrt(x.shape[1]))


def rotations(x: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of a table, applied to the rows."""
    size = 1 << max(0, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    rng = np.random.default_rng([SEED, table])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], size).astype(x.dtype))
    return x


def axes(rotated: np.ndarray, probes: int) -> np.ndarray:
    """The nearest signed axes, nearest first: axis, or axis + size if negative."""
    size = rotated.shape[1]
    signed = np.concatenate([rotated, -rotated], axis=1)
    probes = min(probes, 2 * size)
    near = np.argpartition(-signed, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(signed, near, 1), axis=1, kind="stable"), 1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def lift(x: np.ndarray, norm: float) -> np.ndarray:
    """Onto the unit sphere: rows over ``norm``, the rest of their length in a new coordinate."""
    y = x / norm
    return np.hstack([y, np.sqrt(np.maximum(0.0, 1 - (y * y).sum(axis=1)))[:, None]])


class Index:
    """The tables of one shard: the rows of each axis, and how many meetings make a candidate."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None, starts: np.ndarray | None = None, least: int = 1):
        self.ids, self.x, self.least = ids, x, least
        norms = np.linalg.norm(x, axis=1)
        self.norm, self.level = float(norms.max()), norms.max() - norms.min() <= 1e-5 * norms.max()
        self.rows, self.starts = rows, starts

    @classmethod
    def built(cls, ids: np.ndarray, x: np.ndarray, k: int) -> Index:
        out = cls(ids, x)
        place = (x / out.norm if out.level else lift(x, out.norm)).astype(np.float32)
        rows, starts = [], []
        for t in range(TABLES):
            hashes = np.concatenate([axes(rotations(place[i : i + 8192], t), 1)[:, 0] for i in range(0, len(place), 8192)])
            rows.append(np.argsort(hashes, kind="stable").astype(np.int32))
            size = 2 << max(0, (place.shape[1] - 1).bit_length())
            starts.append(np.searchsorted(hashes[rows[-1]], np.arange(size + 1)))
        out.rows, out.starts = np.stack(rows), np.stack(starts)
        out._fit(k)
        return out

    def _fit(self, k: int) -> None:
        """The most meetings with which a sample of rows still finds its nearest ones, and the recall then."""
        sample = np.random.default_rng(SEED).permutation(len(self.ids))[:AUDITED]
        reached = np.zeros(TABLES + 1, np.int64)
        total = 0
        for i, met in zip(sample, self.meetings(self.x[sample]), strict=True):
            scores = self.x @ self.x[i]
            scores[self.ids == self.ids[i]] = -np.inf
            near = np.argsort(-scores, kind="stable")[: min(k, int((scores > -np.inf).sum()))]
            reached += np.bincount(met[near], minlength=TABLES + 1)[::-1].cumsum()[::-1]
            total += len(near)
        good = np.flatnonzero(reached >= RECALL * total)
        self.least = int(good[-1]) if len(self.ids) > TABLES * PROBES else 0
        self.recall = float(reached[self.least] / total) if total else 1.0

    def meetings(self, q: np.ndarray):
        """For each query, in how many tables it meets each row."""
        place = unit(q) if self.level else np.pad(unit(q), ((0, 0), (0, 1)))
        probes = np.stack([axes(rotations(place.astype(np.float32), t), PROBES) for t in range(TABLES)], axis=1)
        tables = np.arange(TABLES)[:, None]
        low, high = self.starts[tables, probes], self.starts[tables, probes + 1]
        for i in range(len(q)):
            met = [rows[a:b] for rows, lo, hi in zip(self.rows, low[i].tolist(), high[i].tolist(), strict=True) for a, b in zip(lo, hi, strict=True)]
            yield np.bincount(np.concatenate(met), minlength=len(self.ids))

    def search(self, qid: np.ndarray, q: np.ndarray, k: int):
        """(query id, base ids, scores, rows ranked) of each query's best k among its candidates."""
        for i, met in enumerate(self.meetings(q)):
            found = np.flatnonzero(met >= self.least)
            found = found[self.ids[found] != qid[i]]
            if len(found) < k:
                found = np.flatnonzero(self.ids != qid[i])
            ranked, scores = len(found), self.x[found] @ q[i]
            if len(found) > k:
                keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                found, scores = found[keep], scores[keep]
            best = np.lexsort((self.ids[found], -scores))[:k]
            yield qid[i], self.ids[found[best]], scores[best], ranked


def candidates(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score, ranked): each shard's best k a query, with the number of rows it
    compared there; and (shard, size, least, recall) of each shard's index."""
    rows = staged(usable(vectors, id_col, vec_col), "vectors")
    layout = Layout(rows)
    asked = rows.where(is_query(F.col("id")))

    def index(group: pd.DataFrame) -> dict[str, np.ndarray]:
        ids = group["id"].to_numpy()
        x = matrix(group["v"])
        made = Index.built(ids, x, min(k, -(-2 * k // layout.of[x.shape[1]][1])))
        return {"ids": ids, "x": made.x, "rows": made.rows, "starts": made.starts, "size": np.array(len(ids)), "least": np.array(made.least), "recall": np.array(made.recall)}

    def answer(arrays: dict, batches):
        shard = Index(arrays["ids"], arrays["x"], arrays["rows"], arrays["starts"], int(arrays["least"]))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.iloc[at : at + 256], []
                for q, ids, scores, ranked in shard.search(part["id"].to_numpy(), matrix(part["v"]), k):
                    out.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": scores, "ranked": ranked}))
                yield pd.concat(out, ignore_index=True)

    if not layout.total:
        spark = vectors.sparkSession
        return spark.createDataFrame([], FOUND), spark.createDataFrame([], "shard long, size long, least long, recall double")
    root, reports = build(rows, layout, "id", index, "size long, least long, recall double")
    return ask(asked, layout, "id", asked.count(), root, answer, FOUND), reports


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best found for every row that ``is_query`` (a
    function of the id column) selects, among all other rows."""
    found, _ = candidates(vectors, is_query, k, id_col, vec_col)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
