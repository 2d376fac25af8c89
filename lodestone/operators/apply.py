"""From issues to accepted fixes, and from fixes to a changed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import Schema
from .detect import ROW, cells, detect_all, severity_rank
from .policy import Context, evaluate
from .repair import majorities, propose
from .verify import explain, verify

MOST_ATTEMPTS = 3


def attempts(df: DataFrame, issues: DataFrame, schema: Schema | None, context: Context | None = None) -> DataFrame:
    """Every issue's candidate with its safety verdict, verification and status.

    ``status``: accepted, denied, escalated, rejected, unknown or attempts_not_fixed (no candidate);
    ``attempt_number``: 1, or MOST_ATTEMPTS where a deterministic candidate fails every time.
    Accepted fixes change the table that later candidates meet. Candidates on cells outside all
    dependencies don't meet, so one verification decides them. For a dependency's dependent,
    replayed one by one, a conflicting group is repaired exactly if one row departs from a strict
    majority; verification against the unchanged table gives the same answer, since that row then
    has no other row against it. Groups with several departing rows stay, as each candidate still
    meets another one.
    """
    fixes = evaluate(propose(issues, df, schema), schema, context)
    checked = verify(df, fixes, schema)
    status = F.when(F.col("verdict") == "DENY", "denied").when(F.col("verdict") == "ESCALATE", "escalated").when(F.col("verification") == "ACCEPT", "accepted").when(F.col("verification") == "UNKNOWN", "unknown").otherwise("rejected")
    decided = checked.withColumn("status", status).withColumn("explanation", F.when(F.col("status") == "rejected", explain(F.col("unsat_core"))))
    key = issues.select(ROW, "column", F.col("issue_type").alias("detector_id")).distinct()
    every = key.join(decided, [ROW, "column", "detector_id"], "left")
    number = F.when(F.col("status").isin("accepted", "escalated"), 1).when(F.col("status").isNull(), 1).otherwise(MOST_ATTEMPTS)
    return every.withColumn("attempt_number", number).withColumn("status", F.coalesce("status", F.lit("attempts_not_fixed")))


def accepted(df: DataFrame, issues: DataFrame, schema: Schema | None, context: Context | None = None) -> DataFrame:
    return attempts(df, issues, schema, context).where("status = 'accepted'")


def repair(df: DataFrame, schema: Schema | None = None, context: Context | None = None) -> tuple[DataFrame, DataFrame]:
    """(changed table, accepted fixes) of one detection pass."""
    fixes = accepted(df, detect_all(df, schema), schema, context)
    return apply_fixes(df, fixes), fixes


def repairable_groups(df: DataFrame, determinant: tuple[str, ...], dependent: str) -> DataFrame:
    """Conflicting groups with exactly one row outside a strict majority."""
    return majorities(df, determinant, dependent).where("majority is not null and rows - majority_rows = 1")


def last_writes(fixes: DataFrame, order: str = "seq") -> DataFrame:
    """One fix a cell: the last written."""
    return fixes.withColumn("rn", F.row_number().over(Window.partitionBy(ROW, "column").orderBy(F.desc(order)))).where("rn = 1").drop("rn")


def first_by_severity(fixes: DataFrame) -> DataFrame:
    order = Window.partitionBy(ROW, "column").orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "det_ord", "col_ord")
    return fixes.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def apply_fixes(df: DataFrame, fixes: DataFrame) -> DataFrame:
    """The table with each fix's cell replaced, where the cell still holds the fix's old value.

    Fixes of a row travel as one map, so a table is joined once whatever its width.
    """
    maps = fixes.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("old_value", "new_value")))).alias("_fixes"))
    joined = df.join(maps, ROW, "left")
    return joined.select(ROW, *(F.when(F.col("_fixes").isNull(), F.col(f"`{c}`")).otherwise(F.when(F.element_at("_fixes", c)["old_value"].eqNullSafe(F.col(f"`{c}`")), F.element_at("_fixes", c)["new_value"]).otherwise(F.col(f"`{c}`"))).alias(c) for c in cells(df)))


def stale_fixes(df: DataFrame, fixes: DataFrame) -> DataFrame:
    """Fixes whose cell is missing or no longer holds the old value, with what it holds."""
    held = F.create_map(*(x for c in cells(df) for x in (F.lit(c), F.col(f"`{c}`"))))
    joined = fixes.join(df.select(ROW, held.alias("_held")), ROW, "left").withColumn("current_value", F.element_at("_held", F.col("column")))
    return joined.where(~F.col("current_value").eqNullSafe(F.col("old_value"))).drop("_held")
