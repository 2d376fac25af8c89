"""Column profiles of a table, as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exact_mean, exact_medians
from ..functions.text import to_double
from .detect import ROW, cells

SAMPLES = 5


def _value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, v, n): how often each column (by number) holds each non-empty value. One scan, combined
    before the shuffle; each column also has a row without a value, so that empty ones are kept."""
    cell = lambda i, c: F.struct(F.lit(i).alias("i"), F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`").cast("string")).alias("v"))
    return df.select(F.explode(F.array(*(cell(i, c) for i, c in enumerate(columns)))).alias("x")).groupBy("x.i", "x.v").agg(F.count("*").alias("n"))


def _named(columns: list[str]):
    return F.element_at(F.array(*map(F.lit, columns)), F.col("i") + 1).alias("column")


def column_profile(df: DataFrame, columns: list[str] | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """(column, type, total, non_null, null_count, unique_count, min, max, mean).

    Nulls and blanks are missing; numbers are the cells that parse. The table is scanned once: its
    cells are counted by column and value, and those counts by column.
    """
    columns, types = columns or cells(df), types or {}
    counted = _value_counts(df, columns).withColumn("number", to_double(F.col("v")))
    known, number = F.when(F.col("v").isNotNull(), F.col("n")), F.col("number")
    out = counted.groupBy("i").agg(F.sum("n").alias("total"), F.coalesce(F.sum(known), F.lit(0)).alias("non_null"), F.count("v").alias("unique_count"), F.min(number).alias("min"), F.max(number).alias("max"), exact_mean(number, weight=F.col("n")).alias("mean"))
    kind = F.element_at(F.array(*(F.lit(types.get(c, "string")) for c in columns)), F.col("i") + 1).alias("type")
    return out.select(_named(columns), kind, "total", "non_null", (F.col("total") - F.col("non_null")).alias("null_count"), "unique_count", "min", "max", "mean")


def sample_values(df: DataFrame, column: str, n: int = SAMPLES) -> DataFrame:
    """The first ``n`` values of a column in row order."""
    return df.where((F.col(column).isNotNull()) & (F.col(column).cast("string") != "")).orderBy(ROW).limit(n).select(ROW, F.col(column).cast("string").alias("value"))


def first_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(ROW).limit(n)


def rows_at(df: DataFrame, indices: list[int], most: int = 10) -> DataFrame:
    """The rows of the first ``most`` listed indices that exist."""
    return df.where(F.col(ROW).isin(indices[:most]))


def seeded_sample(df: DataFrame, n: int = 10, seed: int = 0) -> DataFrame:
    """The same ``n`` rows for the same seed, by hash, in row order; all rows if there are fewer."""
    return df.orderBy(F.xxhash64(ROW, F.lit(seed)), ROW).limit(n).orderBy(ROW)


def bench_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, non_empty_count, unique_count, median) with the exact median of the parsed numbers."""
    columns = columns or cells(df)
    counts = _value_counts(df, columns).groupBy("i").agg(F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0)).alias("non_empty_count"), F.count("v").alias("unique_count"))
    middle = exact_medians(df, {c: to_double(F.col(f"`{c}`").cast("string")) for c in columns})
    median = F.element_at(F.array(*(F.lit(None if middle[c] is None else round(middle[c], 4)).cast("double") for c in columns)), F.col("i") + 1)
    return counts.select(_named(columns), "non_empty_count", "unique_count", median.alias("median"))
