"""Full-table profiles: one scan for all counts, one grouped aggregate for symbols, one for distinct values."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DECIMAL_TYPES, MONETARY_TYPES, ColumnConfig
from ..functions import money, numeric, temporal
from ..functions.text import named, trim
from .cells import Level, cell, null_flag, number_stages, staged

#: Aggregates in one job; more columns than these take several scans, so that generated code stays compiled.
MAX_AGGREGATES = 90
TEXT_TYPES = ("string", "identifier")


def _metrics(name: str, config: ColumnConfig) -> tuple[list[Level], dict[str, Column]]:
    """Stages and the aggregates of a column; all read only cells that are not nullish."""
    c, some = named(name), ~named(f"__null__{name}")
    count = lambda p: F.count_if(some & F.coalesce(p, F.lit(False)))
    kind = config.type
    own = lambda part: f"__{part}__{name}"
    ref = lambda part: named(own(part))
    out = {"non_nullish_count": F.count_if(some)}
    if kind in TEXT_TYPES:
        length = F.when(some, F.length(trim(c)))
        return [], out | {"min_length": F.coalesce(F.min(length), F.lit(0)), "max_length": F.coalesce(F.max(length), F.lit(0))}
    if kind == "boolean":
        made = cell(name, config)
        return made.stages, out | {"true_count": count(made.value), "false_count": count(~made.value), "unrecognized_count": count(made.value.isNull())}
    if kind == "integer":
        return [{own("clean"): numeric.strip_groups(trim(c))}], out | {"parse_match_count": count(numeric.is_integer(ref("clean")))}
    if kind in DECIMAL_TYPES:
        stages = [*number_stages(name, config), {own("match"): numeric.is_decimal(ref("clean")), own("sep"): numeric.decimal_separator(ref("clean"))}, {own("norm"): numeric.plain_decimal(ref("clean"), ref("sep"))}]
        parsed = some & F.coalesce(ref("match"), F.lit(False))
        return stages, out | {
            "parse_match_count": F.count_if(parsed),
            "comma_decimal_count": F.count_if(parsed & (ref("sep") == ",")),
            "dot_decimal_count": F.count_if(parsed & (ref("sep") == ".")),
            "max_scale": F.coalesce(F.max(F.when(parsed, numeric.significant_scale(ref("norm")))), F.lit(0)),
            "max_integer_digits": F.coalesce(F.max(F.when(parsed, numeric.integer_digits(ref("norm")))), F.lit(0)),
        }
    if kind in ("date", "datetime"):
        made, order = cell(name, config), temporal.date_order_of if kind == "date" else temporal.datetime_order_of
        cut = temporal.stages(c, name)[0]
        stages = [*made.stages[:-1], made.stages[-1] | {own("day"): F.coalesce(order(cut, True), F.lit(False)), own("month"): F.coalesce(order(cut, False), F.lit(False))}]
        return stages, out | {"format_match_count": count(made.value.isNotNull()), "order_ambiguous_count": count(ref("day") & ref("month")), "order_decisive_count": count(ref("day") != ref("month"))}
    if kind == "time":
        made = cell(name, config)
        return made.stages, out | {"format_match_count": count(made.value.isNotNull())}
    made = cell(name, config)
    return made.stages, out | {"valid_count": count(made.valid), "invalid_count": count(~made.valid)}


def profile_counts(df: DataFrame, columns: dict[str, ColumnConfig], tokens=()) -> DataFrame:
    """(column_name, metric, value): the integer aggregates of every column, all columns in one scan (or a few for wide tables)."""
    parts, size, part = [], 0, {}
    for name, config in columns.items():
        metrics = _metrics(name, config)
        if part and size + len(metrics[1]) > MAX_AGGREGATES:
            parts.append(part)
            part, size = {}, 0
        part[name] = metrics
        size += len(metrics[1])
    parts.append(part)
    out = None
    for part in parts:
        flagged = df.select(*(named(c) for c in part), *(null_flag(c, tokens).alias(f"__null__{c}") for c in part))
        flagged = staged(flagged, [s for s, _ in part.values()])
        keys = [(c, m) for c, (_, metrics) in part.items() for m in metrics]
        one = flagged.agg(*(part[c][1][m].cast("bigint").alias(f"v{i}") for i, (c, m) in enumerate(keys)))
        found = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(m).alias("metric"), F.col(f"v{i}").alias("value")) for i, (c, m) in enumerate(keys)))))
        out = found if out is None else out.union(found)
    return out


def distinct_counts(df: DataFrame, columns: list[str], tokens=(), approximate: bool = False) -> DataFrame:
    """(column_name, distinct_count) of trimmed cells that are not nullish.

    The cells are spread out once, made distinct by column and value with partial aggregation, and counted; the rows are
    not multiplied by the number of columns as several distinct counts in one aggregate would.
    """
    cells = df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.when(~null_flag(c, tokens), trim(named(c))).alias("v")) for c in columns))))
    if approximate:
        return cells.groupBy("column_name").agg(F.approx_count_distinct("v").alias("distinct_count"))
    return cells.groupBy("column_name", "v").agg(F.lit(1)).groupBy("column_name").agg(F.count("v").alias("distinct_count"))


def duplicates(df: DataFrame, column: str, tokens=()) -> DataFrame:
    """One row: non_nullish_count, distinct_count, duplicate_count, uniqueness_ratio."""
    value = F.when(~null_flag(column, tokens), trim(named(column))).alias("v")
    one = df.select(value).groupBy("v").agg(F.count("v").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_nullish_count"), F.count("v").alias("distinct_count"))
    ratio = F.when(F.col("non_nullish_count") > 0, F.col("distinct_count") / F.col("non_nullish_count")).otherwise(F.lit(1.0))
    return one.withColumn("duplicate_count", F.col("non_nullish_count") - F.col("distinct_count")).withColumn("uniqueness_ratio", ratio)


def symbol_metrics(df: DataFrame, columns: dict[str, ColumnConfig], tokens=()) -> DataFrame:
    """(column_name, metric_name, metric_value, count) of monetary columns.

    Currency columns have symbol and symbol_position, accounting columns symbol, sign_notation, negative_marker and
    positive_marker.  Null values are not counted.
    """
    columns = {c: config for c, config in columns.items() if config.type in MONETARY_TYPES}
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, metric_name string, metric_value string, count bigint")
    df = df.select(*(F.when(~null_flag(c, tokens), named(c)).alias(c) for c in columns))
    read = {c: money.around_stages(named(c), c) for c in columns}
    for level in zip(*(levels for _, levels in read.values())):
        df = df.withColumns({k: v for made in level for k, v in made.items()})
    structs = []
    for name, config in columns.items():
        surroundings, accounting = read[name][0], config.type == "accounting"
        metrics = {"symbol": money.currency_symbol(surroundings, accounting, config.cr_negative)}
        if accounting:
            negative, positive = money.words_of_sign(config.cr_negative)
            metrics |= {"sign_notation": F.when(surroundings.isNotNull(), money.sign_notation(surroundings, config.cr_negative)), "negative_marker": money.marker_of(surroundings, negative), "positive_marker": money.marker_of(surroundings, positive)}
        else:
            metrics["symbol_position"] = money.symbol_position(surroundings)
        structs += [F.struct(F.lit(name).alias("column_name"), F.lit(m).alias("metric_name"), v.alias("metric_value")) for m, v in metrics.items()]
    cells = df.select(F.inline(F.array(*structs))).where("metric_value is not null")
    return cells.groupBy("column_name", "metric_name", "metric_value").agg(F.count("*").alias("count"))


def dominant(metrics: DataFrame) -> DataFrame:
    """(column_name, metric_name, metric_value, count): the most frequent value; of equal ones the lexicographically first."""
    best = metrics.groupBy("column_name", "metric_name").agg(F.min(F.struct((-F.col("count")).alias("n"), F.col("metric_value").alias("v"))).alias("m"))
    return best.select("column_name", "metric_name", F.col("m.v").alias("metric_value"), (-F.col("m.n")).alias("count"))


def _ratio(part: int, whole: int, default: float = 1.0) -> float:
    return part / whole if whole > 0 else default


def profile(df: DataFrame, columns: dict[str, ColumnConfig], tokens=(), approximate_unique: bool = False) -> dict[str, dict[str, Any]]:
    """The profile of each column: a bounded number of figures a column, gathered by at most three kinds of jobs."""
    texts = [c for c, config in columns.items() if config.type in TEXT_TYPES]
    counts = [tuple(r) for r in profile_counts(df, columns, tokens).collect()]
    distinct = {r.column_name: r.distinct_count for r in distinct_counts(df, texts, tokens, approximate_unique).collect()} if texts else {}
    monetary = any(config.type in MONETARY_TYPES for config in columns.values())
    return assemble(columns, counts, distinct, [tuple(r) for r in symbol_metrics(df, columns, tokens).collect()] if monetary else [])


def assemble(columns: dict[str, ColumnConfig], counts, distinct: dict[str, int], symbols) -> dict[str, dict[str, Any]]:
    """Profiles from (column, metric, value), the distinct values of text columns, and (column, metric, value, count) of monetary ones."""
    out: dict[str, dict[str, Any]] = {c: {"profile_type": config.type} for c, config in columns.items()}
    for c, metric, value in counts:
        out[c][metric] = value
    for c, metric, value, n in sorted(symbols, key=lambda x: (x[0], x[1], -x[3], x[2])):
        out[c].setdefault(f"{metric}_distribution", {})[value] = n
    for c, config in columns.items():
        own = out[c]
        n = own["non_nullish_count"]
        if config.type in TEXT_TYPES:
            own["distinct_count"] = distinct.get(c, 0)
            own["distinct_ratio"] = _ratio(own["distinct_count"], n)
        if config.type == "identifier":
            own["duplicate_count"], own["uniqueness_ratio"] = n - own["distinct_count"], own["distinct_ratio"]
        if "valid_count" in own:
            own["valid_ratio"] = _ratio(own["valid_count"], n)
        if config.type == "boolean":
            own["recognized_ratio"] = _ratio(own["true_count"] + own["false_count"], n)
        if config.type in MONETARY_TYPES:
            _coverage(own, n)
    return out


def _coverage(own: dict[str, Any], n: int) -> None:
    """Symbol coverage: detected and missing counts, the dominant symbol and whether there are several."""
    symbols = own.setdefault("symbol_distribution", {})
    detected = sum(symbols.values())
    first = next(iter(symbols), None)
    own |= {"symbol_detected_count": detected, "symbol_missing_count": n - detected, "symbol_detected_ratio": _ratio(detected, n), "symbol_missing_ratio": _ratio(n - detected, n, 0.0)}
    own |= {"dominant_symbol": first, "dominant_symbol_ratio": _ratio(symbols.get(first, 0), n), "mixed_symbols": len(symbols) > 1}
    if own["profile_type"] == "accounting":
        signs = own.setdefault("sign_notation_distribution", {})
        own |= {f"{k}_count": signs.get(k, 0) for k in ("parentheses", "leading_sign", "trailing_sign")} | {"explicit_sign_count": n - signs.get("unsigned", 0)}
    else:
        forms: dict[str, int] = {}
        for symbol, count in symbols.items():
            alpha = [x.isalpha() for x in symbol]
            form = "code" if all(alpha) else "composite" if any(alpha) else "symbol"
            forms[form] = forms.get(form, 0) + count
        own["token_form_distribution"] = dict(sorted(forms.items(), key=lambda x: (-x[1], x[0])))


def pattern_consistency(profiles: dict[str, dict[str, Any]]) -> float:
    """The mean share of the dominant symbol over the monetary columns; 1 without any."""
    shares = [p["dominant_symbol_ratio"] for p in profiles.values() if "dominant_symbol_ratio" in p]
    return sum(shares) / len(shares) if shares else 1.0
