"""Typed conversion of a raw table, with an issue for every cell that does not parse."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DECIMAL_TYPES, ISSUES_VARIANT, RAW_VARIANT, ColumnConfig, InvalidRequest, Options
from ..functions.numeric import decimal_type
from ..functions.text import named
from .cells import cell, issue_code, null_flag, staged
from .rows import drop_empty_rows, drop_empty_rows_once, fresh, indexed_by_place, with_row_index

AUDIT = ("_row_index", "_parse_error_count", "_raw_row", "_parse_issues", RAW_VARIANT, ISSUES_VARIANT)
#: Columns handled in one projection; wider tables get several, so that generated methods stay small.
CHUNK = 40


def sizes_from_profile(profile: dict[str, dict[str, int]], columns: dict[str, ColumnConfig]) -> dict[str, tuple[int, int]]:
    """(precision, scale) of each decimal column from its profile's max_scale and max_integer_digits."""
    return {c: decimal_type(profile[c]["max_scale"], profile[c]["max_integer_digits"]) for c, config in columns.items() if config.type in DECIMAL_TYPES and c in profile}


def convert_cells(df: DataFrame, columns: dict[str, ColumnConfig], tokens=(), sizes: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """For each column c: c itself (raw), __typed__c and __issue__c.  Other columns of ``df`` pass through.

    A nullish cell is null without an issue; any other has a value or an issue, a category outside the list both.  This
    has no state, so it runs on streams as it is.
    """
    names = list(columns)
    for at in range(0, len(names), CHUNK):
        part = {c: columns[c] for c in names[at : at + CHUNK]}
        cells = {c: cell(c, config, *(sizes or {}).get(c, (18, 2))) for c, config in part.items()}
        keep = df.columns
        staged_ = staged(df.withColumns({f"__null__{c}": null_flag(c, tokens) for c in part}), [x.stages for x in cells.values()])
        flag = lambda c: named(f"__null__{c}")
        typed = [F.when(~flag(c), x.value).alias(f"__typed__{c}") if part[c].type != "string" else F.when(~flag(c), named(c)).alias(f"__typed__{c}") for c, x in cells.items()]
        issue = [F.when(~flag(c) & ~x.valid, F.lit(issue_code(part[c]))).alias(f"__issue__{c}") for c, x in cells.items()]
        df = staged_.select(*(named(c) for c in keep), *typed, *issue)
    return df


def convert(df: DataFrame, columns: dict[str, ColumnConfig], options: Options | None = None, sizes: dict[str, tuple[int, int]] | None = None, order_by=(), keep_raw: bool = False, placed: str | None = None, numbered: bool = True) -> DataFrame:
    """The typed columns, _row_index, _parse_error_count, _raw_row and _parse_issues; with ``keep_raw`` also __raw__c and __issue__c.

    _parse_issues is JSON of the failing cells alone, null for a row without any; _raw_row is JSON of all raw cells, nulls
    included, only where the options ask for it.  ``placed`` names a column of ``monotonically_increasing_id`` that was
    written with the source: rows are then numbered by it, without a sort of the whole table.  A column to be converted that
    has the name of one of the audit's raises InvalidRequest; other columns of ``df`` don't matter, whatever they are called.
    Without ``numbered`` there is no _row_index and no order: for what only counts rows and cells, as quality does, all is one scan.
    """
    options = options or Options()
    names = list(columns)
    if clash := set(AUDIT).intersection(names):
        raise InvalidRequest(f"columns of the audit can't be converted: {', '.join(sorted(clash))}")
    # A source that was written with its places holds its cells; elsewhere they may be dear to compute.
    rows = df if not options.drop_empty_rows else drop_empty_rows(df, names) if placed else drop_empty_rows_once(df, names)
    (index,) = fresh(rows, "_row_index")
    indexed = rows if not numbered else indexed_by_place(rows, index, placed) if placed else with_row_index(rows, index, order_by)
    found = convert_cells(indexed, columns, options.null_tokens, sizes)
    issue = lambda c: named(f"__issue__{c}")
    errors = reduce(lambda a, b: a + b, (F.when(issue(c).isNotNull(), 1).otherwise(0) for c in names), F.lit(0))
    found = found.withColumn("_parse_error_count", errors.cast("int"))
    failing = F.struct(*(F.when(issue(c).isNotNull(), F.struct(named(c).alias("raw"), issue(c).alias("code"))).alias(c) for c in names))
    raw = F.to_json(F.struct(*(named(c) for c in names)), {"ignoreNullFields": "false"})
    with_raw = options.full_raw_row or bool({"changes", "full"} & set(options.trace_mode))
    return found.select(
        *(named(f"__typed__{c}").alias(c) for c in names),
        *([F.col(index).alias("_row_index")] if numbered else []),
        "_parse_error_count",
        *([raw.alias("_raw_row")] if with_raw else []),
        F.when(F.col("_parse_error_count") > 0, F.to_json(failing)).alias("_parse_issues"),
        *([named(c).alias(f"__raw__{c}") for c in names] + [issue(c).alias(f"__issue__{c}") for c in names] if keep_raw else []),
    )


def export(converted: DataFrame, columns: dict[str, ColumnConfig], options: Options | None = None) -> DataFrame:
    """The columns that are published: the error count is not, the raw row and the variants only if asked for.

    Variants need ``convert(..., keep_raw=True)``.  The variant of the issues is null where there is none.  A row whose cells
    together pass Spark's bound of a variant (16 MB at least) ends the job; its texts have no such bound.
    """
    options = options or Options()
    raw = F.to_variant_object(F.struct(*(named(f"__raw__{c}").alias(c) for c in columns))).alias(RAW_VARIANT)
    variants = [raw, F.parse_json("_parse_issues").alias(ISSUES_VARIANT)] if options.variants else []
    return converted.select(*(named(c) for c in columns), "_row_index", *(["_raw_row"] if options.full_raw_row else []), "_parse_issues", *variants)
