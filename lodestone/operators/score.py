"""Scores of repairs against clean tables, and of runs against each other."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_mean
from .detect import ROW, cells

MOST_CALLS = 500


def cell_diff(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """(_row, column, dirty_value, clean_value) of every differing cell; rows match by ``_row``."""
    names = cells(clean)
    d = dirty.select(ROW, *(F.col(f"`{c}`").alias(f"d{i}") for i, c in enumerate(names)))
    both = clean.join(d, ROW)
    pair = lambda i, c: F.when(~F.col(f"`{c}`").eqNullSafe(F.col(f"d{i}")), F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("dirty_value"), F.col(f"`{c}`").alias("clean_value")))
    return both.select(ROW, F.explode(F.filter(F.array(*(pair(i, c) for i, c in enumerate(names))), lambda x: x.isNotNull())).alias("x")).select(ROW, "x.*")


def aligned(dirty: DataFrame, clean: DataFrame) -> DataFrame:
    """``dirty`` under the clean table's header, by position; unequal widths or lengths are errors."""
    if len(cells(dirty)) != len(cells(clean)):
        raise ValueError("the tables differ in their number of columns")
    if dirty.count() != clean.count():
        raise ValueError("the tables differ in their number of rows")
    return dirty.select(ROW, *(F.col(f"`{a}`").alias(b) for a, b in zip(cells(dirty), cells(clean), strict=True)))


def counted(truth: DataFrame, predicted: DataFrame, group: list[str] | None = None) -> DataFrame:
    """tp, fp and fn by ``group``: a prediction is right if its cell's clean value equals new_value."""
    group = group or []
    t = truth.select(*group, ROW, "column", "clean_value", F.lit(1).alias("is_truth"))
    p = predicted.select(*group, ROW, "column", "new_value", F.lit(1).alias("is_pred"))
    both = t.join(p, [*group, ROW, "column"], "full_outer")
    right = F.col("is_truth").isNotNull() & F.col("is_pred").isNotNull() & (F.col("clean_value") == F.col("new_value"))
    right = F.coalesce(right, F.lit(False))
    return both.groupBy(*group).agg(F.count_if(right).alias("tp"), F.count_if(F.col("is_pred").isNotNull() & ~right).alias("fp"), F.count_if(F.col("is_truth").isNotNull() & ~right).alias("fn"))


def rates(counts: DataFrame) -> DataFrame:
    """With precision, recall and F1 to four places; 0 where undefined; F1 from unrounded rates."""
    safe = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    p, r = safe(tp, tp + fp), safe(tp, tp + fn)
    return counts.withColumns({"precision": F.round(p, 4), "recall": F.round(r, 4), "f1": F.round(safe(2 * p * r, p + r), 4)})


def summary(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one), least, most, median and number of a value by group."""
    v = F.col(value)
    return df.groupBy(*group).agg(exact_mean(v).alias("mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.median(v).alias("median"), F.count(v).alias("n"))


def aggregate_runs(records: DataFrame) -> DataFrame:
    """By method and dataset: status, runs completed, and mean and deviation of each measure over the
    runs that went well; a pair without any is 'skipped'."""
    ok = F.col("status") == "ok"
    out = [F.count_if(ok).alias("seeds_completed"), F.min(F.when(~ok, F.col("skip_reason"))).alias("_skip")]
    for c in ("precision", "recall", "f1", "avg_steps", "quota_units", "runtime_s"):
        v = F.when(ok, F.coalesce(F.col(c), F.lit(0.0)))
        out += [exact_mean(v).alias(f"{c}_mean"), F.when(F.count(v) > 0, F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 4)).alias(f"{c}_std")]
    got = records.groupBy("method", "dataset").agg(*out)
    return got.withColumn("status", F.when(F.col("seeds_completed") > 0, "ok").otherwise("skipped")).withColumn("skip_reason", F.when(F.col("seeds_completed") == 0, F.col("_skip"))).drop("_skip")


def across_datasets(runs: DataFrame) -> DataFrame:
    """Mean of each method's dataset means, by method name; skipped methods stay."""
    return runs.groupBy("method").agg(F.max(F.when(F.col("status") == "ok", "ok").otherwise(None)).alias("ok"), *(exact_mean(F.col(f"{c}_mean")).alias(c) for c in ("precision", "recall", "f1", "avg_steps"))).withColumn("status", F.coalesce("ok", F.lit("skipped"))).drop("ok").orderBy("method")


def quota_units(calls: Column, tokens: Column) -> Column:
    return F.round(F.greatest(calls / 1000, tokens / 100_000), 4)


def chunk_size(rows: int, chunks: int = 20) -> int:
    return ceil(rows / chunks)


def with_chunks(df: DataFrame, rows: int) -> DataFrame:
    """Contiguous chunks of a fixed size, about twenty."""
    return df.withColumn("chunk", F.floor(F.col(ROW) / F.lit(max(1, chunk_size(rows)))))


def estimated_calls(methods: list[str], dataset_rows: list[int], seeds: int, allow_more: bool = False) -> int:
    """Model calls that a benchmark would need; over MOST_CALLS is an error unless allowed."""
    chunks = sum(ceil(n / chunk_size(n)) for n in dataset_rows if n)
    calls = sum(chunks * seeds * {"llm_zeroshot": 1, "llm_react": 2}.get(m, 0) for m in methods)
    if calls > MOST_CALLS and not allow_more:
        raise ValueError(f"about {calls} calls exceed {MOST_CALLS}")
    return calls


def nearest_rank(df: DataFrame, value: str, share: float) -> DataFrame:
    """The nearest-rank percentile, such as a latency's p95."""
    return df.agg(F.expr(f"percentile_disc({share}) within group (order by {value})").alias("value"))
