"""A confirmed conversion over a stream, and counts of a profile kept up to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ColumnConfig
from ..functions.text import named
from ..operators.convert import convert_cells
from ..operators.rows import not_empty


def convert_stream(raw: DataFrame, columns: dict[str, ColumnConfig], tokens=(), sizes: dict[str, tuple[int, int]] | None = None, drop_empty: bool = True) -> DataFrame:
    """The typed columns, _parse_error_count and _parse_issues of a streaming table.

    Types and decimal sizes are fixed beforehand, so there is no state; row numbers, which need all rows before, are not
    made.
    """
    names = list(columns)
    rows = raw.where(not_empty(names)) if drop_empty else raw
    found = convert_cells(rows, columns, tokens, sizes)
    issue = lambda c: named(f"__issue__{c}")
    errors = reduce(lambda a, b: a + b, (F.when(issue(c).isNotNull(), 1).otherwise(0) for c in names), F.lit(0)).cast("int")
    failing = F.struct(*(F.when(issue(c).isNotNull(), F.struct(named(c).alias("raw"), issue(c).alias("code"))).alias(c) for c in names))
    others = [named(c) for c in raw.columns if c not in columns]
    return found.select(*others, *(named(f"__typed__{c}").alias(c) for c in names), errors.alias("_parse_error_count"), F.when(errors > 0, F.to_json(failing)).alias("_parse_issues"))


def issue_counts(converted: DataFrame, event_time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and errors by window of event time; rows later than ``late`` behind the newest do not count.

    Times without a zone are read in the session's zone, as a watermark needs an instant, and windows are shown as such again.
    """
    kind = converted.schema[event_time].dataType.simpleString()
    marked = converted.withColumn(event_time, F.col(event_time).cast("timestamp_ltz")).withWatermark(event_time, late)
    counts = marked.groupBy(F.window(event_time, window)).agg(F.count("*").alias("row_count"), F.sum("_parse_error_count").alias("error_count"))
    return counts.select(F.col("window.start").cast("timestamp_ntz" if kind == "timestamp_ntz" else "timestamp_ltz").alias("window_start"), "row_count", "error_count")
