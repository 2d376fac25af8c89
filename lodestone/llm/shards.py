"""Vectors dealt into shards whose index is built once, and queries streamed past every shard."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, settle, staged

#: A shard holds about this many numbers, so it fits in a task's memory whatever the dimension; a table of
#: SPREAD_ROWS vectors a shard is spread over up to SPREAD shards. A task asks for about BLOCK_ROWS queries.
SHARD_VALUES, SPREAD_ROWS, SPREAD, BLOCK_ROWS = 1 << 22, 4096, 8, 1 << 20


def is_usable(id_col: str, vec_col: str):
    """Whether a row has an id and a vector that isn't null, empty or zero and holds only finite numbers."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.col(id_col).cast("long").isNotNull() & F.coalesce(sound, F.lit(False))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the usable rows."""
    return vectors.where(is_usable(id_col, vec_col)).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))


def count_shards(n: int, dimension: int) -> int:
    return max(-(-n * dimension // SHARD_VALUES), min(SPREAD, -(-n // SPREAD_ROWS)))


class Layout:
    """The shards of each dimension: vectors only meet others of their dimension."""

    def __init__(self, rows: DataFrame):
        self.of: dict[int, tuple[int, int]] = {}  # dimension -> first shard, shards
        self.total = 0
        for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():
            shards = count_shards(r["n"], r["d"])
            self.of[r["d"]] = (self.total, shards)
            self.total += shards

    def _pick(self, value: Callable[[int, int], object]):
        """``value`` of a row's dimension."""
        return reduce(lambda rest, d: F.when(F.size("v") == d, value(*self.of[d])).otherwise(rest), self.of, F.lit(None))

    def own(self, key: str):
        """The shard that holds a row."""
        return self._pick(lambda first, n: F.pmod(F.xxhash64(key), F.lit(n)) + first).cast("long")

    def all(self):
        """All shards of a row's dimension."""
        return self._pick(lambda first, n: F.sequence(F.lit(first), F.lit(first + n - 1)))


def matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def build(base: DataFrame, layout: Layout, key: str, index: Callable[[pd.DataFrame], dict[str, np.ndarray]], report: str) -> tuple[str, DataFrame]:
    """Build each shard's index from its rows, once, and file it in the shared folder.

    ``index`` gives arrays, those named in ``report`` (a schema) with one number each, which the
    table returned holds a shard. A file appears complete under its name, so a task that is run
    again only replaces it.
    """
    root = new_path(base.sparkSession, "index")
    files, path = _files(root)
    files.create_dir(path)
    names = [c.split()[0] for c in report.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        parts = [b for b in batches if len(b)]
        if parts:
            rows = pd.concat(parts, ignore_index=True)
            del parts
            for shard, group in rows.groupby("shard"):
                data = io.BytesIO()
                arrays = index(group.sort_values(key, ignore_index=True))
                np.savez(data, **arrays)
                name = f"{path}/{int(shard):08d}.npz"
                temp = f"{name}.{TaskContext.get().taskAttemptId()}.tmp"
                with files.open_output_stream(temp) as out:
                    out.write(data.getbuffer())
                files.move(temp, name)
                yield pd.DataFrame({"shard": [int(shard)], **{n: [arrays[n].item()] for n in names}})
        settle()

    placed = base.withColumn("shard", layout.own(key)).repartitionById(layout.total, F.col("shard").cast("int"))
    return root, staged(placed.mapInPandas(run, f"shard long, {report}"), "index-reports")


def ask(queries: DataFrame, layout: Layout, key: str, n: int, root: str, answer: Callable[[dict, Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``answer`` of each shard's arrays and the queries of its dimension, which stream past it in batches.

    Every task has one shard and one block of the queries.
    """
    files, path = _files(root)
    blocks = max(1, -(-n // BLOCK_ROWS))
    asked = queries.withColumn("shard", F.explode(layout.all())).withColumn("block", F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks)))

    def run(batches):
        def of(shard: int, first: pd.DataFrame):
            with files.open_input_file(f"{path}/{shard:08d}.npz") as f:
                arrays = dict(np.load(io.BytesIO(f.read())))
            yield from answer(arrays, streamed(shard, first))

        def streamed(shard: int, first: pd.DataFrame):
            yield first
            for b in left:
                if len(b):
                    yield b

        left = (b for b in batches)
        for b in left:
            if len(b):
                yield from of(int(b["shard"].iloc[0]), b)
        settle()

    return asked.repartitionById(layout.total * blocks, (F.col("shard") * blocks + F.col("block")).cast("int")).mapInPandas(run, schema)
