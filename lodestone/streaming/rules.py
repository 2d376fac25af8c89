"""Row-local rules over a stream of rows; the batch operators hold for all else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rules import broken


def broken_in_stream(rows: DataFrame, checks: list[Column]) -> DataFrame:
    """Issues of an unbounded table: the checks need no state."""
    return broken(rows, checks)


def issue_counts(issues: DataFrame, time: str, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Issues by type and window; windows close once rows are later than ``lateness``."""
    return issues.withWatermark(time, lateness).groupBy(F.window(time, window), "type").agg(F.count("*").alias("n"))
