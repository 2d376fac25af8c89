"""Issues and fixes as JSON and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .detect import ROW, row_lists, severity_rank


def issues_json(issues: DataFrame) -> DataFrame:
    """One JSON object a column, type and severity, with its distinct rows and their number."""
    return row_lists(issues).select(F.to_json(F.struct("column", "issue_type", "severity", "row_indices", F.col("n").alias("count"))).alias("json"))


def fixes_json(fixes: DataFrame) -> DataFrame:
    return fixes.select(F.to_json(F.struct(F.col(ROW).alias("row"), "column", "old_value", "new_value", "detector_id", "reason", "confidence", "provenance")).alias("json"))


def profile_lines(issues: DataFrame) -> DataFrame:
    """A profile's table, most severe first."""
    ordered = issues.orderBy(severity_rank(F.col("severity")), F.desc("confidence"), "det_ord", "col_ord", ROW)
    return ordered.select(F.format_string("%-8s %6d  %-20s %-16s %.2f  %s", "severity", ROW, "column", "issue_type", "confidence", "reason").alias("line"))


def diff_lines(fixes: DataFrame) -> DataFrame:
    return fixes.orderBy(ROW, "column").select(F.format_string("row %d, %s: '%s' -> '%s' (%s)", ROW, "column", "old_value", "new_value", "detector_id").alias("line"))


def attempt_lines(attempts: DataFrame) -> DataFrame:
    """Why issues stay unfixed."""
    failed = attempts.where("status <> 'accepted'")
    why = F.coalesce("explanation", "safety_reason", F.lit("no candidate"))
    return failed.orderBy(ROW, "column").select(F.format_string("row %d, %s: %s after %d attempts: %s", ROW, "column", "status", "attempt_number", why).alias("line"))


def session_lines(steps: DataFrame, task: str) -> DataFrame:
    """A replayed session's log."""
    return steps.orderBy("episode", "step").select(F.format_string("[STEP] task=%s step=%d result=%s reward=%.4f total=%.4f", F.lit(task), "step", "result", "delta", "cumulative").alias("line"))
