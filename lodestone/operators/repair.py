"""Repair proposals for detected issues, as frames of candidate fixes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import Schema
from ..functions.text import SENTINELS, strip
from .detect import DOMINANCE, ROW, cells, column_statistics, dependency_pairs, severity_rank

FIX = "_row bigint, column string, old_value string, new_value string, detector_id string, operation string, reason string, confidence double, provenance string"
CARRIED = ("issue_type", "severity", "det_ord", "col_ord", "first")

#: A repairer maps issues, their table and its schema to candidate fixes.
Repairer = Callable[[DataFrame, DataFrame, Schema | None], DataFrame]


def _fix(issues: DataFrame, new_value, detector: str, reason) -> DataFrame:
    first = F.col("first") if "first" in issues.columns else F.lit(0).cast("long").alias("first")
    return issues.select(ROW, "column", F.col("raw").alias("old_value"), new_value.alias("new_value"), F.lit(detector).alias("detector_id"), F.lit("update").alias("operation"), reason.alias("reason"), "confidence", F.lit("deterministic").alias("provenance"), "issue_type", "severity", "det_ord", "col_ord", first)


def repair_decimal_shift(issues: DataFrame, df: DataFrame, schema: Schema | None = None) -> DataFrame:
    """The expected value, unless the cell already spells it."""
    hit = issues.where((F.col("issue_type") == "decimal_shift") & F.col("expected").isNotNull() & (F.col("expected") != F.col("raw")))
    return _fix(hit, F.col("expected"), "decimal_shift", F.concat(F.lit("Apply the detected power-of-ten correction for column '"), F.col("column"), F.lit("'.")))


def repair_type_mismatch(issues: DataFrame, df: DataFrame, schema: Schema | None = None, stats: dict | None = None) -> DataFrame:
    """Blank for a word that stands for a missing value in a mostly numeric column."""
    stats = stats or column_statistics(df, cells(df), medians=False)
    numeric = [c for c, s in stats.items() if (n := s["numeric"] + s["date"] + s["string"]) and s["numeric"] / n >= DOMINANCE]
    hit = issues.where((F.col("issue_type") == "type_mismatch") & F.col("column").isin(numeric) & F.lower(strip(F.col("raw"))).isin(*SENTINELS) & (F.col("raw") != ""))
    return _fix(hit, F.lit(""), "type_mismatch", F.concat(F.lit("Normalize sentinel value '"), F.col("raw"), F.lit("' to a blank cell in predominantly numeric column '"), F.col("column"), F.lit("'.")))


def majorities(df: DataFrame, determinant: tuple[str, ...], dependent: str) -> DataFrame:
    """Conflicting groups with their strict majority value; ``majority`` is null on a tie. Aggregates
    alone, so a group may have any number of values."""
    names = [f"k{i}" for i in range(len(determinant))]
    pairs = dependency_pairs(df, determinant, dependent).where("d is not null")
    groups = pairs.groupBy(*names).agg(F.count("*").alias("values"), F.max("n").alias("majority_rows"), F.sum("n").alias("rows"), F.max_by("d", "n").alias("top")).where("values > 1")
    tied = pairs.join(groups, names).where("n = majority_rows").groupBy(*names).agg(F.count("*").alias("winners"))
    return groups.join(tied, names).select(*names, F.when(F.col("winners") == 1, F.col("top")).alias("majority"), "rows", "majority_rows")


def repair_fd_violation(issues: DataFrame, df: DataFrame, schema: Schema | None, resolver: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The strict majority of the row's group under the first dependency whose group conflicts.

    A row that holds the majority stays, and is not tried under later dependencies. Ties go to
    ``resolver`` (rows with the group's keys and values, to which it adds new_value), or stay.
    """
    parts = []
    for at, fd in enumerate(schema.dependencies if schema else ()):
        if not {*fd.determinant, fd.dependent} <= set(df.columns):
            continue
        names = [f"k{i}" for i in range(len(fd.determinant))]
        rows = df.select(ROW, *(F.col(f"`{c}`").alias(n) for c, n in zip(fd.determinant, names, strict=True)))
        hit = issues.where((F.col("issue_type") == "fd_violation") & (F.col("column") == fd.dependent)).join(rows, ROW).join(majorities(df, fd.determinant, fd.dependent), names)
        parts.append(hit.withColumn("fd_ord", F.lit(at)).drop(*names, "rows", "majority_rows"))
    if not parts:
        return _fix(issues.where("false"), F.lit(""), "fd_violation", F.lit(""))
    every = reduce(DataFrame.unionByName, parts)
    one = every.withColumn("rn", F.row_number().over(Window.partitionBy(ROW, "column").orderBy("fd_ord"))).where("rn = 1").drop("rn", "fd_ord")
    new = F.col("majority")
    if resolver:
        one = resolver(one)
        new = F.coalesce("majority", "new_value")
    hit = one.where(new.isNotNull() & (new != F.coalesce("raw", F.lit(""))))
    return _fix(hit, new, "fd_violation", F.concat(F.lit("Use the majority value of the determinant group for column '"), F.col("column"), F.lit("'.")))


def propose(issues: DataFrame, df: DataFrame, schema: Schema | None = None) -> DataFrame:
    """All candidate fixes by issue type, one a cell: that of the issue first in severity order."""
    parts = [repair_decimal_shift(issues, df, schema), repair_type_mismatch(issues, df, schema), repair_fd_violation(issues, df, schema)]
    every = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy(ROW, "column").orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "det_ord", "col_ord", "first")
    return every.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def prefer_minimal_edit(candidates: DataFrame) -> DataFrame:
    """One candidate a cell: that of least edit distance, the earlier (``seq``) on ties."""
    scored = candidates.withColumn("distance", F.levenshtein("old_value", "new_value"))
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy(ROW, "column").orderBy("distance", "seq"))).where("rn = 1").drop("rn")
