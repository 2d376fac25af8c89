"""Shared storage, Arrow mapping and connected components for the operators here."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_OWNERS: list["Scratch"] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir``.

    Only where that is unset and the session runs in one process (tests, a single machine) a
    temporary folder serves; a cluster without a shared folder is an error, as its executors
    would each write to a folder of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    return f"file://{tempfile.gettempdir()}"


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def session_root(spark: SparkSession) -> str:
    """The session's own folder in the shared one; Hadoop deletes it when the session's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        root = f"{shared_dir(spark)}/lodestone-{app}-{uuid.uuid4().hex[:8]}"
        files, path = _file_system(spark, root)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _ROOTS[app] = root
    return _ROOTS[app]


class Scratch:
    """The owner of the tables that are staged while it is entered, which ``clear`` deletes.

    Without an owner staged tables last as long as the session, since the frames returned read them.
    """

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        _OWNERS.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNERS.remove(self)

    def clear(self, spark: SparkSession, needed: DataFrame | None = None) -> None:
        """Delete its tables, but for those that ``needed`` still reads."""
        used = needed.inputFiles() if needed is not None else []
        for path in list(self.paths):
            if not any(f"/{path.rsplit('/', 1)[1]}/" in x for x in used):
                files, target = _file_system(spark, path)
                files.delete(target, True)
                self.paths.remove(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the session's folder, which belongs to the scratch entered last."""
    path = f"{session_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].paths.append(path)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs at most the tasks of the next step.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle() -> None:
    """Give memory that a finished task no longer needs back to the system; workers outlive tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class Recent(dict):
    """A cache of two generations: a full one becomes the old one, whose used entries move on.

    Missing values of strings are made by ``make``; those of over LONGEST letters aren't kept, so
    the number of entries bounds the memory.
    """

    LONGEST = 64

    def __init__(self, most: int, make: Callable):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= self.LONGEST:
            self.put(key, got)
        return got

    def put(self, key: str, value) -> None:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def find(self, key: str):
        """The value if it is known."""
        got = self.get(key)
        return self.old.get(key) if got is None else got


def map_arrow(df: DataFrame, columns: list[str], schema: str, fn: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], rows: int = 512) -> DataFrame:
    """Run ``fn`` over blocks of at most ``rows`` rows, given and returned as columns of lists."""
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        def blocks():
            for batch in batches:
                for at in range(0, batch.num_rows, rows):
                    part = batch.slice(at, rows)
                    yield {c: part.column(i).to_pylist() for i, c in enumerate(columns)}

        for got in fn(blocks()):
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)
        settle()

    return df.select(*columns).mapInArrow(run, out)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of ``edges`` (columns a, b): the smallest id reachable.

    Randomised contraction: in each round every node joins its neighbour of least priority and
    the edges are rewritten onto the joined nodes, so their number falls by a constant factor.
    The first round uses the ids as priorities, which contracts stars around a smallest id at
    once; later rounds hash them anew, so long chains contract in logarithmically many rounds.
    All of it is aggregates and joins, with every round written to the shared folder.
    """
    spark = edges.sparkSession
    norm = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    left = staged(edges.where("a <> b").select(*norm(F.col("a"), F.col("b"))).distinct(), "edges")
    maps: list[DataFrame] = []
    while not is_empty(left):
        k = len(maps)
        rank = (lambda c: F.col(c)) if k == 0 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min_by("b", rank("b")).alias("b"))
        joined = staged(best.select(F.col("a").alias("node"), F.when(rank("b") < rank("a"), F.col("b")).otherwise(F.col("a")).alias("parent")), "parents")
        maps.append(joined)
        pa_ = joined.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        pb_ = joined.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        left = staged(left.join(pa_, "a").join(pb_, "b").where("pa <> pb").select(*norm(F.col("pa"), F.col("pb"))).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).limit(0)
    found = maps[0].select(F.col("node").alias("id"), F.col("parent").alias("root"))
    for m in maps[1:]:
        found = found.join(m.withColumnRenamed("node", "root"), "root", "left").select("id", F.coalesce("parent", "root").alias("root"))
    found = staged(found, "roots")
    least = found.groupBy("root").agg(F.min("id").alias("component"))
    return staged(found.join(least, "root").select("id", "component"), "components")


def keep_rows(docs: DataFrame, text_col: str, build: Callable[[], Callable[[list], list[bool]]], rows: int = 128) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text the function that ``build`` makes on a worker keeps."""
    at = docs.columns.index(text_col)

    def run(batches):
        keep = build()
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))
        del keep
        settle()

    return docs.mapInArrow(run, docs.schema)
