"""Constraint verification of candidate fixes as joins and aggregates.

A candidate is checked against the table with its own cell changed: every cell of the columns that
matter must parse as declared (else UNKNOWN), the new value must lie within its column's bounds, and
no other row of its determinant group may hold another dependent. Group counts answer that last
question for all candidates at once, so the cost is one aggregate a dependency.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.schema import FunctionalDependency, Schema
from ..functions.text import to_double, to_integer
from .detect import ROW, cells


def typed(c: Column, kind: str) -> Column:
    """The cell as a value that equals others as its declared type says."""
    return to_integer(c) if kind == "integer" else to_double(c) if kind == "real" else c


def _relevant(column: str, schema: Schema, present: list[str]) -> tuple[list[FunctionalDependency], list[str]]:
    fds = [d for d in schema.dependencies if column in (*d.determinant, d.dependent) and {*d.determinant, d.dependent} <= set(present)]
    return fds, sorted({column, *(c for d in fds for c in (*d.determinant, d.dependent))})


def bad_cells(df: DataFrame, schema: Schema, columns: list[str]) -> dict[str, int]:
    """Per column, how many cells don't parse as declared; one aggregate."""
    checked = [c for c in columns if schema.kind(c) in ("integer", "real")]
    if not checked:
        return dict.fromkeys(columns, 0)
    got = df.agg(*(F.count_if(typed(F.col(f"`{c}`"), schema.kind(c)).isNull()).alias(f"b{i}") for i, c in enumerate(checked))).first()
    return dict.fromkeys(columns, 0) | {c: got[f"b{i}"] for i, c in enumerate(checked)}


def _bound_labels(column: str, schema: Schema) -> list[Column]:
    out, kind = [], schema.kind(column)
    value = typed(F.col("new_value"), kind).cast("double")
    whole = schema.columns.get(column) == "int"
    for b in schema.bounds:
        if b.column != column or kind not in ("integer", "real"):
            continue
        for edge, name, keeps in ((b.low, "min", (lambda x, y: x >= y) if b.include_low else (lambda x, y: x > y)), (b.high, "max", (lambda x, y: x <= y) if b.include_high else (lambda x, y: x < y))):
            if edge is not None:
                limit = F.lit(float(int(edge)) if whole else float(edge))
                out.append(F.when(~keeps(value, limit), F.concat(F.lit(f"domain::{column}::{name}::row::"), F.col(ROW).cast("string"))))
    return out


def _fd_conflicts(cand: DataFrame, df: DataFrame, column: str, fd: FunctionalDependency, schema: Schema) -> DataFrame:
    """(cand_id, label) of candidates on ``column`` that this dependency refutes."""
    keys = [f"k{i}" for i in range(len(fd.determinant))]
    value = lambda c: typed(F.col(f"`{c}`"), schema.kind(c))
    rows = df.select(ROW, *(value(c).alias(k) for c, k in zip(fd.determinant, keys, strict=True)), value(fd.dependent).alias("d"))
    pairs = rows.groupBy(*keys, "d").agg(F.count("*").alias("same"))
    totals = rows.groupBy(*keys).agg(F.count("*").alias("total"))
    new = typed(F.col("new_value"), schema.kind(column))
    old = cand.join(rows, ROW)
    moved = old.select("cand_id", ROW, *(F.col(k).alias(f"o{k}") for k in keys), F.col("d").alias("od"), *((new if c == column else F.col(k)).alias(k) for c, k in zip(fd.determinant, keys, strict=True)), (new if fd.dependent == column else F.col("d")).alias("d"))
    counted = moved.join(totals, keys, "left").join(pairs, [*keys, "d"], "left")
    stayed = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"o{k}") for k in keys))
    own = F.when(stayed, 1).otherwise(0)
    own_same = F.when(stayed & (F.col("d") == F.col("od")), 1).otherwise(0)
    others, alike = F.coalesce("total", F.lit(0)) - own, F.coalesce("same", F.lit(0)) - own_same
    label = F.concat(F.lit(f"fd::{'+'.join(fd.determinant)}::{fd.dependent}::row::"), F.col(ROW).cast("string"))
    return counted.where(others != alike).select("cand_id", label.alias("label"))


def verify(df: DataFrame, fixes: DataFrame, schema: Schema | None) -> DataFrame:
    """``fixes`` with verification (ACCEPT, REJECT, UNKNOWN) and unsat_core, all the labels that fail.

    Bounds on string columns and unknown declared types give UNKNOWN. Without a schema only the
    cell's existence and the operation are checked.
    """
    present = cells(df)
    cand = fixes.withColumn("cand_id", F.struct(ROW, "column", "new_value", "old_value"))
    known_rows = df.select(F.col(ROW).alias("_known_row"))
    sound = cand.join(known_rows, cand[ROW] == F.col("_known_row"), "left")
    structural = F.col("_known_row").isNotNull() & (F.col("operation") == "update") & F.col("column").isin(*present)
    checks, conflicts = [], []
    if schema:
        every = sorted({c for column in present for c in _relevant(column, schema, present)[1]})
        bad = bad_cells(df, schema, every)
        for column in present:
            fds, relevant = _relevant(column, schema, present)
            kind, here = schema.kind(column), F.col("column") == column
            others = sum(bad[c] for c in relevant if c != column)
            unknown = any(schema.kind(c) == "unknown" for c in relevant) or (kind == "string" and any(b.column == column and (b.low is not None or b.high is not None) for b in schema.bounds))
            labels = _bound_labels(column, schema)
            new_bad = typed(F.col("new_value"), kind).isNull().cast("int") if kind in ("integer", "real") else F.lit(0)
            old_bad = typed(F.col("old_value"), kind).isNull().cast("int") if kind in ("integer", "real") else F.lit(0)
            unparsed = F.lit(unknown) | (F.lit(others + bad[column]) - old_bad + new_bad > 0)
            if labels or unknown or others or kind in ("integer", "real"):
                checks.append((here, unparsed, F.filter(F.array(*labels), lambda x: x.isNotNull()) if labels else F.array().cast("array<string>")))
            for fd in fds:
                conflicts.append(_fd_conflicts(cand.where(here), df, column, fd, schema))
    unparsed, bounds = F.lit(False), F.array().cast("array<string>")
    for here, un, labels in checks:
        unparsed, bounds = F.when(here, un).otherwise(unparsed), F.when(here, labels).otherwise(bounds)
    if conflicts:
        found = reduce(DataFrame.unionAll, conflicts).groupBy("cand_id").agg(F.array_sort(F.collect_set("label")).alias("fd_core"))
        sound = sound.join(found, "cand_id", "left")
    core = F.concat(bounds, F.coalesce(F.col("fd_core"), F.array().cast("array<string>"))) if conflicts else bounds
    verdict = F.when(~structural, "REJECT").when(unparsed, "UNKNOWN").when(F.size(core) > 0, "REJECT").otherwise("ACCEPT")
    kept = F.when(structural & ~unparsed, core).otherwise(F.array().cast("array<string>"))
    return sound.select(*fixes.columns, verdict.alias("verification"), kept.alias("unsat_core"))


def explain(core: Column) -> Column:
    """The labels of a core as sentences (fixed values: their wording)."""

    def said(label: Column) -> Column:
        p = F.split(label, "::")
        domain = F.concat(F.lit("Row "), p[4], F.lit(" would violate the "), F.when(p[2] == "min", "minimum").otherwise("maximum"), F.lit(" bound for column '"), p[1], F.lit("'."))
        fd = F.concat(F.lit("Row "), p[4], F.lit(" would violate FD (functional dependency) "), F.replace(p[1], F.lit("+"), F.lit(", ")), F.lit(" -> "), p[2], F.lit("."))
        other = F.concat(F.lit("Tracked verifier rule '"), label, F.lit("' rejected the fix."))
        full = F.size(p) >= 5
        return F.when(full & (p[0] == "domain"), domain).when(full & (p[0] == "fd"), fd).otherwise(other)

    return F.when(F.size(core) == 0, "The verifier rejected the fix, but did not expose a tracked explanation.").otherwise(F.array_join(F.transform(core, said), " "))
