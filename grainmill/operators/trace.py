"""The trace: one row for each cell in scope, with its raw text, its converted text and its issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ISSUES_VARIANT, RAW_VARIANT, ColumnConfig
from ..functions.text import named, quoted


def trace(converted: DataFrame, columns: dict[str, ColumnConfig], modes=("issues",)) -> DataFrame:
    """(row_index, column_name, raw_value, converted_value, issue_codes) from ``convert(..., keep_raw=True)``.

    Scopes add up: issues (cells with an issue), changes (cells without one whose text changed), full (all cells).  Cells
    out of scope are dropped within the row, before it is spread out; a filter on the error count would be pushed below
    the conversion and have every cell parsed again.
    """
    return _spread(converted, {c: (named(f"__raw__{c}"), named(f"__issue__{c}")) for c in columns}, modes)


def trace_of_published(published: DataFrame, columns: dict[str, ColumnConfig], modes=("issues",)) -> DataFrame:
    """The same from a published table with variants (``Options.variants``): neither the source nor a text of JSON is parsed again.

    Raw cells and issue codes are taken out of a row's two variants in one step each, by the columns' names.  A row without
    an issue has a null variant of issues, so all its codes are null.
    """
    texts = lambda kind: "struct<" + ", ".join(f"{quoted(c)}: {kind}" for c in columns) + ">"
    read = published.select("*", F.variant_get(RAW_VARIANT, "$", texts("string")).alias("__raw"), F.variant_get(ISSUES_VARIANT, "$", texts("struct<code: string>")).alias("__issue"))
    return _spread(read, {c: (F.col("__raw")[c], F.col("__issue")[c]["code"]) for c in columns}, modes)


def _spread(df: DataFrame, parts: dict[str, tuple[Column, Column]], modes) -> DataFrame:
    """One row for each cell in scope, from the raw text and the issue of each column."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), raw.alias("raw_value"), named(c).cast("string").alias("converted_value"), issue.alias("issue_codes")) for c, (raw, issue) in parts.items()))
    if "full" not in modes:
        scopes = {"issues": lambda x: x["issue_codes"].isNotNull(), "changes": lambda x: x["issue_codes"].isNull() & ~x["raw_value"].eqNullSafe(x["converted_value"])}
        cells = F.filter(cells, lambda x: reduce(lambda a, b: a | b, (scopes[m](x) for m in modes)))
    return df.select(F.col("_row_index").alias("row_index"), F.inline(cells))
