"""Fidelity of a conversion, and the verdict on a run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import named

READY, WARNINGS, BLOCKED = "READY", "READY_WITH_WARNINGS", "BLOCKED"


def column_quality(converted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, row_count, null_count, error_count, parse_success_ratio) from ``convert(..., keep_raw=True)``, by one scan.

    Attempted cells are those that were not null at the source: rows less (nulls less errors).  A category outside its
    list is an error with a value, so attempts may exceed rows by the number of such cells.
    """
    sums = [F.count("*").alias("rows")]
    for i, c in enumerate(columns):
        sums += [F.count_if(named(c).isNull()).alias(f"n{i}"), F.count_if(named(f"__issue__{c}").isNotNull()).alias(f"e{i}")]
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), F.col(f"n{i}").alias("null_count"), F.col(f"e{i}").alias("error_count")) for i, c in enumerate(columns)))
    found = converted.agg(*sums).select(F.inline(cells))
    attempted = F.col("row_count") - (F.col("null_count") - F.col("error_count"))
    return found.withColumn("parse_success_ratio", F.when(attempted > 0, 1 - F.col("error_count") / attempted).otherwise(F.lit(1.0)))


def quality(converted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: row_count, cell_count, null_count, error_count, attempted_count, parse_success_ratio, completeness_ratio, quality_score, worst_column_score."""
    by_column = column_quality(converted, columns)
    one = by_column.agg(F.max("row_count").alias("row_count"), F.sum("row_count").alias("cell_count"), F.sum("null_count").alias("null_count"), F.sum("error_count").alias("error_count"), F.min("parse_success_ratio").alias("worst"))
    attempted = F.col("cell_count") - (F.col("null_count") - F.col("error_count"))
    one = one.withColumn("attempted_count", attempted)
    one = one.withColumn("parse_success_ratio", F.when(F.col("attempted_count") > 0, 1 - F.col("error_count") / F.col("attempted_count")).otherwise(F.lit(1.0)))
    complete = F.when(F.col("cell_count") > 0, 1 - F.col("null_count") / F.col("cell_count")).otherwise(F.lit(1.0))
    return one.select("row_count", "cell_count", "null_count", "error_count", "attempted_count", "parse_success_ratio", complete.alias("completeness_ratio"), (100 * F.col("parse_success_ratio")).alias("quality_score"), (100 * F.col("worst")).alias("worst_column_score"))


def verdict(score: float, worst: float, severities: Sequence[str], ready: float = 95.0, warning: float = 85.0) -> str:
    """BLOCKED by an error or a score below ``warning``; READY without warnings at ``ready`` or more; else in between."""
    low = min(score, worst)
    if "ERROR" in severities or low < warning:
        return BLOCKED
    return WARNINGS if low < ready or "WARNING" in severities else READY


def verdict_column(score, worst, errors, warnings, ready: float = 95.0, warning: float = 85.0):
    """The verdict as a Column, from scores and counts of issues by severity."""
    low = F.least(score, worst)
    return F.when((errors > 0) | (low < warning), BLOCKED).when((low < ready) | (warnings > 0), WARNINGS).otherwise(READY)
