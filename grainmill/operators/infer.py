"""Column types from the data: one aggregate counts, for every column at once, the values that fit each type.

The counts run over any DataFrame, so types can be inferred from a prefix, a sample or the whole table; only the counts,
some thirty a column, come to the driver, where the rules pick the type.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnConfig
from ..functions import money, numeric, temporal, values
from ..functions.text import NULL_TOKEN_CANDIDATES, full_match, named, nullish, trim
from .cells import Lookup, null_flag, staged

#: Least shares of cells for a type, for money, for signed numbers and for codes.
MIN_TYPE, MIN_MONEY, MIN_SIGNED, MIN_CODE = 0.55, 0.10, 0.10, 0.95
#: Least cells, share of distinct cells and score of a key.
MIN_ID_SAMPLES, MIN_UNIQUE, MIN_ID_CONFIDENCE = 3, 0.95, 0.75
#: Shapes of keys.
UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
STRUCTURED = r"[A-Za-z]+[-_][A-Za-z0-9][A-Za-z0-9_-]*"
#: Headers that name a table's own key, last words of a header that name another's, words of other keys.
PRIMARY_HEADERS = ("id", "record_id", "row_id", "uuid", "guid")
FOREIGN_ENDINGS = ("id", "uuid", "guid")
KEY_WORDS = ("key", "sku", "code", "number", "no")
ID_WORDS = ("id", "identifier", "uuid", "guid")
#: The kinds of keys in order: score, kind, and what a header's words must be.
HEADER_RULES = (
    (1.0, "primary", lambda words: "_".join(words) in PRIMARY_HEADERS),
    (0.9, "foreign", lambda words: words[-1] in FOREIGN_ENDINGS),
    (0.75, "business_key", lambda words: not set(words).isdisjoint(KEY_WORDS)),
    (0.7, "opaque", lambda words: not set(words).isdisjoint(ID_WORDS)),
)
_CODE_SETS = (("currency_code", None, "currency", True), ("country_code", "alpha_2", "country_alpha_2", True), ("country_code", "alpha_3", "country_alpha_3", True), ("language_code", "alpha_2", "language_alpha_2", False), ("language_code", "alpha_3", "language_alpha_3", False))


#: What may stand around a number once currency and blanks are gone, and what of it makes the number signed.
_AROUND, _SIGNED = r"\A(?:\([+-]?#%?\)|[+-]?#%?)(?:cr|dr|[+-])?\z", r"\(|(?:cr|dr|[+-])\z"


def kind_levels(name: str) -> list[dict[str, Column]]:
    """Levels of columns up to __kind__name: integer, decimal, percentage, currency, signed or accounting by the value's own notation; null if it is no number."""
    own = lambda part: f"__{part}__{name}"
    ref = lambda part: named(own(part))
    cut, levels = money.stages(named(name), name)
    around = F.concat(cut.before, F.lit("#"), cut.behind)
    number = F.substring(cut.low, F.length(cut.before) + 1, F.length(cut.low) - F.length(cut.before) - F.length(cut.behind))
    return [
        *levels,
        {own("around"): around, own("digits"): numeric.strip_groups(number)},
        {own("currency"): ref("around").rlike(money.TOKEN), own("rest"): F.regexp_replace(ref("around"), rf"{money.TOKEN}|\s+", ""), own("sep"): numeric.decimal_separator(ref("digits"))},
        {own("number"): ref("rest").rlike(_AROUND) & numeric.is_decimal(ref("digits")), own("signed"): ref("rest").rlike(_SIGNED)},
        {
            own("kind"): F.when(
                ref("number"),
                F.when(ref("signed") & ref("currency"), "accounting").when(ref("signed"), "signed").when(ref("currency"), "currency")
                .when(ref("rest").contains("%"), "percentage").when(ref("sep") != "", "decimal").otherwise("integer"),
            )
        },
    ]


def evidence(df: DataFrame, tokens=(), codes: bool = False) -> DataFrame:
    """(column_name, metric, value): how many cells that are not nullish fit each type, for all columns of ``df``."""
    # Cells as they stand are counted before they are trimmed, which costs more than to count them.
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), named(c).alias("value")) for c in df.columns))))
    counted = cells.where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("times"))
    return _evidence(counted.where(~null_flag("value", tokens)).withColumn("value", trim(F.col("value"))), codes)


def evidence_of(cells: DataFrame, codes: bool = False) -> DataFrame:
    """The same from (column_name, value) of trimmed cells, as a sample has them; null values don't count."""
    return _evidence(cells.where("value is not null").select("column_name", "value", F.lit(1).cast("bigint").alias("times")), codes)


def _evidence(counted: DataFrame, codes: bool) -> DataFrame:
    """The same from (column_name, value, times): each distinct value is read once and counts as often as it stands there.

    The distinct values are in one row each from then on, so their number and lengths need no other scan.
    """
    cells = counted.groupBy("column_name", F.col("value").alias("v")).agg(F.sum("times").alias("__times"))
    v, low = F.col("v"), F.lower(F.col("v"))
    # Dates, datetimes and times of either order read the same cuts, which are columns.
    cut, levels = temporal.stages(v, "v")
    kinds = ("integer", "decimal", "percentage", "currency", "signed", "accounting")
    tests = {f"is_{k}": F.col("__kind__v") == k for k in kinds}
    tests |= {"is_boolean": low.isin(*values.TRUE_WORDS, *values.FALSE_WORDS), "is_zero_or_one": low.isin("0", "1"), "has_currency": low.rlike(money.TOKEN)}
    for order in (True, False):
        tests |= {f"date_{order}": temporal.date_of(cut, order).isNotNull() & cut.serial.isNull(), f"datetime_{order}": temporal.datetime_of(cut, order).isNotNull() & v.rlike(":")}
    tests |= {"is_time": temporal.time_of(cut).isNotNull(), "is_uuid": full_match(v, UUID), "is_structured": full_match(v, STRUCTURED)}
    read = [*kind_levels("v"), *levels]
    if codes:
        tests |= {f"code_{kind}": F.col(f"__in_{kind}__v").isNotNull() for _, _, kind, _ in _CODE_SETS}
        read += [{"__upper__v": F.upper(v), "__lower__v": low}, *(Lookup(f"__{'upper' if upper else 'lower'}__v", f"__in_{kind}__v", kind) for _, _, kind, upper in _CODE_SETS)]
    rows = staged(cells, [read])
    # One column a reading, so that the aggregate's code stays small.
    rows = rows.withColumns({f"__{m}": F.coalesce(t, F.lit(False)) for m, t in tests.items()})
    held = F.sum("__times").alias("n"), F.count("*").alias("n_unique"), *(F.sum(F.when(F.col(f"__{m}"), F.col("__times")).otherwise(0)).alias(m) for m in tests)
    by_length = rows.groupBy("column_name", F.length("v").alias("length")).agg(*held)
    metrics = ["n", *tests, "n_unique"]
    wide = by_length.groupBy("column_name").agg(*(F.sum(m).alias(m) for m in metrics), F.max("n").alias("same_length"))
    return wide.select("column_name", F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("bigint").alias("value")) for m in (*metrics, "same_length")))))


def header_signal(name: str) -> tuple[float, str]:
    """How much a header looks like a key, and of which kind."""
    words = re.findall(r"[a-z0-9]+", name.lower())
    fits = (rule for rule in HEADER_RULES if words and rule[2](words))
    score, kind, _ = next(fits, (0.0, "opaque", None))
    return score, kind


def decide(name: str, seen: Mapping[str, int], codes: bool = False) -> ColumnConfig:
    """The type of a column from its evidence.  Keys come first, then booleans, numbers, times and, if asked for, codes."""
    n = seen.get("n", 0)
    if not n:
        return ColumnConfig("string")
    share = lambda metric: seen.get(metric, 0) / n
    score, kind = header_signal(name)
    unique = share("n_unique")
    if n >= MIN_ID_SAMPLES and score > 0 and unique >= MIN_UNIQUE:
        shape = max(share("is_uuid"), share("is_structured"), 0.6 * share("same_length"))
        if min(1.0, 0.6 * score + 0.3 * unique + 0.1 * shape) >= MIN_ID_CONFIDENCE:
            return ColumnConfig("identifier", identifier_kind=kind)
    if share("is_boolean") >= MIN_TYPE and seen.get("is_zero_or_one", 0) < seen["is_boolean"]:
        return ColumnConfig("boolean")
    if share("is_integer") >= MIN_TYPE:
        return ColumnConfig("integer")
    if share("is_accounting") >= MIN_MONEY:
        return ColumnConfig("accounting")
    if share("is_signed") >= MIN_SIGNED:
        return ColumnConfig("accounting" if seen.get("has_currency") else "signed")
    if share("is_currency") >= MIN_MONEY:
        return ColumnConfig("currency")
    for kind in ("percentage", "decimal"):
        if share(f"is_{kind}") >= MIN_TYPE:
            return ColumnConfig(kind)
    for kind in ("datetime", "time", "date"):
        if kind == "time":
            if share("is_time") >= MIN_TYPE:
                return ColumnConfig("time")
            continue
        day, month = share(f"{kind}_True"), share(f"{kind}_False")
        if max(day, month) >= MIN_TYPE:
            return ColumnConfig(kind, day_first=day > month)
    if codes:
        fits = [(seen.get(f"code_{key}", 0), -i) for i, (_, _, key, _) in enumerate(_CODE_SETS)]
        best, at = max(fits)
        if best / n >= MIN_CODE:
            kind, form, _, _ = _CODE_SETS[-at]
            return ColumnConfig(kind, code_format=form or "alpha_2")
    return ColumnConfig("string")


def infer_types(df: DataFrame, tokens=(), codes: bool = False) -> dict[str, ColumnConfig]:
    return _decided(df.columns, evidence(df, tokens, codes), codes)


def infer_types_of(cells: DataFrame, names: list[str], tokens=(), codes: bool = False) -> dict[str, ColumnConfig]:
    """The types of the columns ``names`` from a sample of cells; one without cells is a string."""
    return _decided(names, evidence_of(cells.where(~nullish(F.col("value"), tokens)), codes), codes)


def _decided(names: list[str], found: DataFrame, codes: bool) -> dict[str, ColumnConfig]:
    seen: dict[str, dict[str, Any]] = {c: {} for c in names}
    for r in found.collect():
        seen[r.column_name][r.metric] = r.value
    return {c: decide(c, seen[c], codes) for c in names}


def null_tokens_of(cells: DataFrame) -> tuple[str, ...]:
    """The candidates among the cells of a sample."""
    low = F.lower("value").alias("t")
    return tuple(sorted(r.t for r in cells.select(low).where(F.col("t").isin(*NULL_TOKEN_CANDIDATES)).distinct().collect()))


def infer_null_tokens(df: DataFrame) -> tuple[str, ...]:
    """The candidates that occur anywhere, found by one scan."""
    cells = F.array(*(F.lower(trim(named(c))) for c in df.columns))
    found = df.agg(*(F.max(F.array_contains(cells, t)).alias(f"t{i}") for i, t in enumerate(NULL_TOKEN_CANDIDATES))).first()
    return tuple(sorted(t for i, t in enumerate(NULL_TOKEN_CANDIDATES) if found[i]))
