"""Profiles kept up to date: a small state for each part of a source, and states that merge into the profile of the whole."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ColumnConfig
from ..functions.text import named, trim
from ..sources import log
from . import profile
from .cells import null_flag

STATE = "column_name string, metric string, metric_value string, value bigint, sketch binary"
#: Distinct values are counted by sketches of 2^LOG_SIZE registers: a standard error of 1.04 / 2^(LOG_SIZE / 2), here 0.8%.
LOG_SIZE = 14
DISTINCT = "distinct_sketch"


def state(df: DataFrame, columns: dict[str, ColumnConfig], tokens=()) -> DataFrame:
    """The state of a part: its counts, least and greatest figures, distributions, and a sketch of each text column's values.

    Rows are bounded by columns and symbols, not by the part.  An empty part has counts of zero.
    """
    none = lambda kind: F.lit(None).cast(kind)
    counts = profile.profile_counts(df, columns, tokens)
    # A part without cells has no least length that could count for others.
    some = counts.where("metric = 'non_nullish_count' and value > 0").select("column_name")
    counts = counts.where("metric not like 'min!_%' escape '!'").union(counts.where("metric like 'min!_%' escape '!'").join(F.broadcast(some), "column_name", "left_semi"))
    out = counts.select("column_name", "metric", none("string").alias("metric_value"), "value", none("binary").alias("sketch"))
    out = out.union(profile.symbol_metrics(df, columns, tokens).select("column_name", "metric_name", "metric_value", "count", none("binary")))
    texts = [c for c, config in columns.items() if config.type in profile.TEXT_TYPES]
    if texts:
        one = df.agg(*(F.hll_sketch_agg(F.when(~null_flag(c, tokens), trim(named(c))), F.lit(LOG_SIZE)).alias(f"s{i}") for i, c in enumerate(texts)))
        sketches = one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(texts)))))
        out = out.union(sketches.select("column_name", F.lit(DISTINCT), none("string"), none("bigint"), "sketch"))
    return out


def merge(states: DataFrame) -> DataFrame:
    """States put together into one; the order and the grouping of the parts make no difference to counts."""
    value = F.when(F.col("metric").startswith("min_"), F.min("value")).when(F.col("metric").startswith("max_"), F.max("value")).otherwise(F.sum("value"))
    rest = states.where(F.col("metric") != DISTINCT).groupBy("column_name", "metric", "metric_value").agg(value.alias("value"))
    sketches = states.where(F.col("metric") == DISTINCT).groupBy("column_name", "metric").agg(F.hll_union_agg("sketch").alias("sketch"))
    return rest.withColumn("sketch", F.lit(None).cast("binary")).unionByName(sketches, allowMissingColumns=True).select("column_name", "metric", "metric_value", "value", "sketch")


def profile_of(merged: DataFrame, columns: dict[str, ColumnConfig]) -> dict[str, dict[str, Any]]:
    """The profile of a merged state, as ``profile.profile`` gives it with approximate distinct counts."""
    rows = merged.select("column_name", "metric", "metric_value", "value", F.hll_sketch_estimate("sketch").alias("distinct")).collect()
    counts = [(r.column_name, r.metric, r.value) for r in rows if r.metric_value is None and r.metric != DISTINCT]
    known = {(c, m) for c, m, _ in counts}
    counts += [(c, "min_length", 0) for c, config in columns.items() if config.type in profile.TEXT_TYPES and (c, "min_length") not in known]
    # A sketch may name a few more values than there are cells.
    cells = {c: v for c, m, v in counts if m == "non_nullish_count"}
    distinct = {r.column_name: min(r.distinct, cells.get(r.column_name, 0)) for r in rows if r.metric == DISTINCT}
    return profile.assemble(columns, counts, distinct, [(r.column_name, r.metric, r.metric_value, r.value) for r in rows if r.metric_value is not None])


def add_part(df: DataFrame, columns: dict[str, ColumnConfig], folder: str, name: str, tokens=()) -> None:
    """Adds a part's state to the folder under its name; a name that is there is not read again.  It costs a scan of the part alone."""
    if not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"a part's name has letters, digits, - and _ alone: {name}")
    log.put_once(df.sparkSession, folder, name, "profile", lambda: state(df, columns, tokens).coalesce(1))


def profile_of_parts(spark: SparkSession, columns: dict[str, ColumnConfig], folder: str) -> dict[str, dict[str, Any]]:
    """The profile of all parts in the folder; no part is scanned."""
    return profile_of(merge(log.read(spark, folder)), columns)
