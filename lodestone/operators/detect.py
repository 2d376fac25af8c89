"""Detectors: type mismatches, power-of-ten shifts, functional-dependency violations.

One wide aggregate counts every column's classes (columns, not rows, reach the driver); medians are
narrowed down for the columns with enough numbers alone; a last pass emits the flagged cells of the
columns that qualify.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import Schema
from ..functions.stats import exact_medians, sketched_middle
from ..functions.text import classify, general, half_even, is_blank, quoted, strip, to_double

ROW = "_row"
CLASSES = ("numeric", "date", "string")

# Thresholds of the detectors.
DOMINANCE = 0.65
LEAST_CLASSIFIED, LEAST_NUMERIC = 2, 5
NEGLIGIBLE = 1e-10
LOG_TOLERANCE, MOST_POWER = 0.15, 3
SEVERITIES = ("UNSAFE", "REVIEW", "SAFE")

#: A detector maps a table and its schema to issues.
Detector = Callable[[DataFrame, Schema | None], DataFrame]
ISSUE = "_row bigint, column string, issue_type string, severity string, confidence double, expected string, actual string, reason string, raw string, det_ord int, col_ord int"


def cells(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def severity_rank(c: Column) -> Column:
    return F.when(c == "UNSAFE", 0).when(c == "REVIEW", 1).otherwise(2)


def column_statistics(df: DataFrame, columns: list[str], approximate: bool = False, medians: bool = True) -> dict[str, dict]:
    """Per column: counts of the value classes, numbers parsed, and with ``medians`` the median of
    columns of at least LEAST_NUMERIC numbers (None with a NaN)."""
    if not columns:
        return {}
    value = {c: to_double(F.col(f"`{c}`")) for c in columns}
    parsed, exprs = [], []
    for i, c in enumerate(columns):
        # each cell is classified and parsed once, ahead of the aggregates that read it
        parsed.append(F.when(~is_blank(F.col(f"`{c}`")), classify(F.col(f"`{c}`"))).alias(f"kind{i}"))
        exprs += [F.count_if(F.col(f"kind{i}") == k).alias(f"{k}{i}") for k in CLASSES]
        if medians:
            parsed.append(value[c].alias(f"value{i}"))
            exprs += [F.count(f"value{i}").alias(f"n{i}"), F.count_if(F.isnan(f"value{i}")).alias(f"nan{i}")]
            exprs.append(F.percentile_approx(f"value{i}", 0.5, 10_000).alias(f"median{i}") if approximate else sketched_middle(F.col(f"value{i}")).alias(f"bounds{i}"))
    got = df.select(*parsed).agg(*exprs).first()
    out = {c: {k: got[f"{k}{i}"] for k in CLASSES} for i, c in enumerate(columns)}
    if medians:
        numeric = {c: value[c] for i, c in enumerate(columns) if got[f"n{i}"] >= LEAST_NUMERIC and not got[f"nan{i}"]}
        middle = {c: got[f"median{columns.index(c)}"] for c in numeric} if approximate else exact_medians(df, numeric, {c: (got[f"n{(i := columns.index(c))}"], *got[f"bounds{i}"]) for c in numeric})
        out = {c: out[c] | {"n": got[f"n{i}"], "median": middle.get(c)} for i, c in enumerate(columns)}
    return out


def _emit(df: DataFrame, structs: list[Column]) -> DataFrame:
    """A row for each non-null struct of each row."""
    if not structs:
        return df.sparkSession.createDataFrame([], ISSUE)
    return df.select(ROW, F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("i")).select(ROW, "i.*")


def detect_type_mismatch(df: DataFrame, schema: Schema | None = None, stats: dict | None = None) -> DataFrame:
    """Non-blank cells whose class differs from the one that at least DOMINANCE of the column has."""
    stats, structs = stats or column_statistics(df, cells(df), medians=False), []
    for at, c in enumerate(cells(df)):
        counts = [stats[c][k] for k in CLASSES]
        total, most = sum(counts), max(counts)
        if total < LEAST_CLASSIFIED or most == total or most / total < DOMINANCE:
            continue
        main, ratio = CLASSES[counts.index(most)], most / total
        confidence = round(min(0.95, ratio + max(0.0, 0.10 * (1 - (total - most) / total))), 2)
        raw = F.col(f"`{c}`")
        actual, kind = strip(raw), classify(raw)
        said = lambda text: F.concat(F.lit("Value '"), actual, F.lit(f"' {text} '{c}'"))  # noqa: E731, B023
        reason = (
            F.when(F.lit(main == "numeric") & (kind == "string"), said("is non-numeric in predominantly numeric column"))
            .when(F.lit(main == "string") & (kind == "numeric"), said("looks numeric in predominantly string column"))
            .when(F.lit(main == "string") & (kind == "date"), said("looks like a date in predominantly string column"))
            .otherwise(F.concat(F.lit("Value '"), actual, F.lit("' (type: "), kind, F.lit(f") conflicts with dominant type '{main}' in column '{c}'")))
        )
        issue = F.struct(F.lit(c).alias("column"), F.lit("type_mismatch").alias("issue_type"), F.lit("REVIEW").alias("severity"), F.lit(confidence).alias("confidence"), F.lit(None).cast("string").alias("expected"), actual.alias("actual"), reason.alias("reason"), raw.alias("raw"), F.lit(0).alias("det_ord"), F.lit(at).alias("col_ord"))
        structs.append(F.when(~is_blank(raw) & (kind != main), issue))
    return _emit(df, structs)


def shift_power(value: Column, median: float) -> Column:
    """The whole power of ten, 1 to 3 either way, that separates a value from the median, else null."""
    log = F.when(F.abs(value) >= NEGLIGIBLE, F.log10(F.abs(value / F.lit(median))))
    power = F.rint(log)
    fits = (F.abs(power) >= 1) & (F.abs(power) <= MOST_POWER) & (F.abs(log - power) < LOG_TOLERANCE) & (F.abs(value / F.lit(median)) >= NEGLIGIBLE)
    return F.when(fits, power)


def detect_decimal_shift(df: DataFrame, schema: Schema | None = None, stats: dict | None = None) -> DataFrame:
    """Numbers about 10, 100 or 1000 times the column's median, or that fraction of it."""
    stats, structs, names = stats or column_statistics(df, cells(df)), [], cells(df)
    for at, c in enumerate(names):
        median = stats[c]["median"]
        if stats[c]["n"] < LEAST_NUMERIC or median is None or abs(median) < NEGLIGIBLE or abs(median) == float("inf"):
            continue
        raw = F.col(f"`{c}`")
        value = to_double(raw)
        power = shift_power(value, median)
        structs.append(F.when(power.isNotNull(), F.struct(F.lit(c).alias("column"), value.alias("value"), power.alias("power"), F.abs(F.log10(F.abs(value / F.lit(median))) - power).alias("distance"), F.lit(float(median)).alias("median"), raw.alias("raw"), F.lit(at).alias("col_ord"))))
    if not structs:
        return df.sparkSession.createDataFrame([], ISSUE)
    found = df.select(ROW, F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("i")).select(ROW, "i.*")
    factor = F.pow(F.lit(10.0), F.col("power"))
    up = F.concat(F.lit("x the typical value (median ~"), general("median"), F.lit(")"))
    down = F.concat(F.lit("x too small compared to the typical value (median ~"), general("median"), F.lit(")"))
    many = F.concat(factor.cast("long").cast("string"), up)
    few = F.concat(general(F.lit(1.0) / factor), down)
    reason = F.concat(F.lit("Value "), general("value"), F.lit(" in column '"), F.col("column"), F.lit("' appears to be ~"), F.when(F.col("power") > 0, many).otherwise(few))
    confidence = half_even(F.least(F.lit(0.95), F.greatest(F.lit(0.70), 1.0 - F.col("distance") * 2.0)), F.lit(2))
    expected = F.col("value") / factor
    return found.select(ROW, "column", F.lit("decimal_shift").alias("issue_type"), F.lit("REVIEW").alias("severity"), confidence.alias("confidence"), general(expected).alias("expected"), strip(F.col("raw")).alias("actual"), reason.alias("reason"), "raw", F.lit(1).alias("det_ord"), "col_ord")


def dependency_pairs(df: DataFrame, determinant: tuple[str, ...], dependent: str) -> DataFrame:
    """(k0.., d, at, n): each determinant's dependents with their first row and number of rows. Nulls
    are no determinant."""
    keys = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(determinant)]
    names = [f"k{i}" for i in range(len(determinant))]
    known = df.select(ROW, *keys, F.col(f"`{dependent}`").alias("d")).dropna(subset=names)
    return known.groupBy(*names, "d").agg(F.min(ROW).alias("at"), F.count("*").alias("n"))


def dependency_groups(df: DataFrame, determinant: tuple[str, ...], dependent: str, listed: bool = True) -> DataFrame:
    """Determinant groups with several dependents: columns of the determinant, ``first``, the group's
    first row, ``distinct`` and, if ``listed``, ``values`` in first-seen order. Nulls are no determinant
    and no dependent."""
    names = [f"k{i}" for i in range(len(determinant))]
    more = [F.array_sort(F.collect_list(F.when(F.col("d").isNotNull(), F.struct("at", "d", "n")))).alias("values")] * listed
    groups = dependency_pairs(df, determinant, dependent).groupBy(*names).agg(F.min("at").alias("first"), F.count("d").alias("distinct"), *more)
    return groups.where("distinct > 1")


def detect_fd_violation(df: DataFrame, schema: Schema | None = None, stats: dict | None = None, listed: bool = True) -> DataFrame:
    """Every row of a determinant group that holds several dependents. The reason lists the group's
    values; with ``listed`` off it gives their number alone, so that a determinant of very many rows
    and values costs neither a list nor a copy of it a row, and ``dependency_report`` has the values."""
    out = []
    for at, fd in enumerate(schema.dependencies if schema else ()):
        if not {*fd.determinant, fd.dependent} <= set(df.columns):
            continue
        names = [f"k{i}" for i in range(len(fd.determinant))]
        groups = dependency_groups(df, fd.determinant, fd.dependent, listed)
        desc = F.concat_ws(", ", *(F.concat(F.lit(f"{c}='"), F.col(n), F.lit("'")) for c, n in zip(fd.determinant, names, strict=True)))
        said = F.concat(F.lit(" maps to multiple values: {"), F.array_join(F.transform("values", lambda v: quoted(v["d"])), ", "), F.lit("}")) if listed else F.concat(F.lit(" maps to "), F.col("distinct"), F.lit(" values"))
        reason = F.concat(F.lit(f"Functional dependency {fd.determinant} -> {fd.dependent} violated: "), desc, said)
        rows = df.select(ROW, F.col(f"`{fd.dependent}`").alias("raw"), *(F.col(f"`{c}`").alias(n) for c, n in zip(fd.determinant, names, strict=True)))
        hit = rows.join(groups.select(*names, reason.alias("reason"), "first"), names)
        out.append(hit.select(ROW, F.lit(fd.dependent).alias("column"), F.lit("fd_violation").alias("issue_type"), F.lit("UNSAFE").alias("severity"), F.lit(0.95).alias("confidence"), F.lit(None).cast("string").alias("expected"), F.coalesce("raw", F.lit("None")).alias("actual"), "reason", "raw", F.lit(2).alias("det_ord"), F.lit(at).alias("col_ord"), "first"))
    if not out:
        return df.sparkSession.createDataFrame([], ISSUE).withColumn("first", F.lit(0).cast("long"))
    return reduce(DataFrame.unionByName, out)


def dependency_report(df: DataFrame, determinant: tuple[str, ...], dependent: str) -> DataFrame:
    """(k0.., value, first, rows) of every conflicting determinant: one row a value, for display."""
    names = [f"k{i}" for i in range(len(determinant))]
    pairs = dependency_pairs(df, determinant, dependent).where("d is not null")
    bad = pairs.groupBy(*names).agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return pairs.join(bad, names, "left_semi").select(*names, F.col("d").alias("value"), F.col("at").alias("first"), F.col("n").alias("rows"))


DETECTORS: tuple[Detector, ...] = (detect_type_mismatch, detect_decimal_shift, detect_fd_violation)


def detect_all(df: DataFrame, schema: Schema | None = None) -> DataFrame:
    """All detectors' issues, one a (row, column, type): the first in detector, column, row order."""
    stats = column_statistics(df, cells(df))
    parts = [detect_type_mismatch(df, schema, stats), detect_decimal_shift(df, schema, stats), detect_fd_violation(df, schema)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).withColumn("first", F.coalesce("first", F.lit(0)))
    order = Window.partitionBy(ROW, "column", "issue_type").orderBy("det_ord", "col_ord", "first")
    return every.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def sort_issues(issues: DataFrame) -> DataFrame:
    """By severity, then falling confidence, then detector, column, group and row order."""
    return issues.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "det_ord", "col_ord", "first", ROW)


def has_unsafe(issues: DataFrame) -> DataFrame:
    """One row: whether any issue is unsafe (the exit status of a profile)."""
    return issues.agg(F.coalesce(F.bool_or(F.col("severity") == "UNSAFE"), F.lit(False)).alias("unsafe"))


def summarize(issues: DataFrame) -> DataFrame:
    """By column, type and severity: the number of distinct rows, the first and the last."""
    rows = issues.groupBy("column", "issue_type", "severity", ROW).agg(F.lit(1).alias("one"))
    return rows.groupBy("column", "issue_type", "severity").agg(F.count("*").alias("n"), F.min(ROW).alias("first_row"), F.max(ROW).alias("last_row"))


def row_lists(issues: DataFrame) -> DataFrame:
    """The same groups with all their rows, sorted, in one cell: for documents that hold such lists."""
    return issues.groupBy("column", "issue_type", "severity").agg(F.array_sort(F.collect_set(ROW)).alias("row_indices"), F.countDistinct(ROW).alias("n"))


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))
