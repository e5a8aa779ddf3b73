"""Rows: the empty-row filter and a gap-free index without a global sort."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank_in_row, named, nullish, structural_null
from ..scratch import table

#: A place's lower bits number the rows of a part, those above them the parts.
POSITION_BITS = 33


def not_empty(columns: Sequence[str]) -> Column:
    """Whether some cell holds more than blanks, tabs and line ends."""
    return reduce(lambda a, b: a | b, (~blank_in_row(named(c)) for c in columns), F.lit(False))


def drop_empty_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.where(not_empty(columns or df.columns))


def drop_empty_rows_once(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same where cells are dear to compute: a filter that needs a row's place stays above what computes the cells, which is not done once more for it."""
    (place,) = fresh(df, "__place")
    return df.withColumn(place, F.monotonically_increasing_id()).where(not_empty(columns) & (F.col(place) >= 0)).drop(place)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of one's own, each with underscores before it until no column of ``df`` is called so, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_index(df: DataFrame, name: str = "_row_index", order_by: Sequence[str] = ()) -> DataFrame:
    """Adds 1, 2, 3, ... in the order of the columns ``order_by``, else in the order in which the source is read.

    Rows are numbered within partitions, written once to the shared folder so that the numbers can't change between jobs,
    and moved by the sum of the partitions before: one small row a partition.  No window runs over the whole table.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    at = F.monotonically_increasing_id()
    part, own, base = fresh(df, "__part", "__at", "__before")
    placed = table(df.select("*", F.shiftright(at, POSITION_BITS).alias(part), at.bitwiseAND((1 << POSITION_BITS) - 1).alias(own)), "row-index")
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(part, before.alias(base))
    # One row for each partition of the job, some hundred thousand at most.
    return placed.join(F.broadcast(bases), part).withColumn(name, F.col(base) + F.col(own) + 1).drop(part, own, base)


def indexed_by_place(df: DataFrame, name: str, place: str) -> DataFrame:
    """Adds 1, 2, 3, ... in the order of ``place``, a stored ``monotonically_increasing_id``, which goes.

    The part of the source is in its upper bits: rows are numbered within their part, and moved by the rows of the parts
    before.  Only the rows of a part meet in a task, as they did when the source was read.
    """
    part, of, base, at = fresh(df, "__part", "__base_of", "__before", "__own")
    rows = df.withColumn(part, F.shiftright(place, POSITION_BITS))
    counts = rows.groupBy(part).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col(part).alias(of), before.alias(base))
    own = F.row_number().over(Window.partitionBy(part).orderBy(place))
    # One row for each partition of the job that read the source, some hundred thousand at most.
    joined = rows.withColumn(at, own).join(F.broadcast(bases), F.col(part) == F.col(of))
    return joined.withColumn(name, (F.col(base) + F.col(at)).cast("bigint")).drop(part, of, base, at, place)


def column_counts(df: DataFrame, tokens: Sequence[str] = ()) -> DataFrame:
    """(column_name, row_count, null_count, nullish_count, empty_row_count) from one scan; empty rows are all nullish."""
    names = df.columns
    empty = reduce(lambda a, b: a & b, (nullish(named(c), tokens) for c in names), F.lit(True))
    sums = [F.count("*").alias("rows"), F.count_if(empty).alias("empty")]
    for i, c in enumerate(names):
        sums += [F.count_if(F.coalesce(structural_null(named(c)), F.lit(True))).alias(f"n{i}"), F.count_if(nullish(named(c), tokens)).alias(f"m{i}")]
    one = df.agg(*sums)
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col("rows").alias("row_count"), F.col(f"n{i}").alias("null_count"), F.col(f"m{i}").alias("nullish_count"), F.col("empty").alias("empty_row_count")) for i, c in enumerate(names)))
    return one.select(F.inline(cells))
