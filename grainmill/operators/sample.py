"""The first values of every column in the order of the source; no column is brought into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import named, trim
from ..scratch import table
from .cells import null_flag
from .rows import POSITION_BITS


def first_values(df: DataFrame, k: int, place: str, tokens=()) -> DataFrame:
    """(column_name, position, value): the first ``k`` cells of each column that are not nullish, trimmed, repeats included.

    ``place`` names a column that rises in the order of the source and numbers what is read together in its bits above the
    lowest 33, as ``read_source`` gives it.  A first scan counts the cells of each column and part; sums of these over the
    parts tell which parts hold a column's first ``k`` cells, ``k`` parts a column at most.  A second scan reads no further
    than the last such part, and each task keeps ``k`` cells of a part at most.  A column without values has no rows.
    """
    names = [c for c in df.columns if c != place]
    values = {c: F.when(~null_flag(c, tokens), trim(named(c))) for c in names}
    part = F.shiftright(named(place), POSITION_BITS)
    if not names or k < 1:
        return df.sparkSession.createDataFrame([], "column_name string, position int, value string")
    sums = df.groupBy(part.alias("part")).agg(*(F.count(v).alias(f"n{i}") for i, v in enumerate(values.values())))
    counts = sums.select("part", F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n")) for i, c in enumerate(names)))))
    # One row for each part and column: the parts of a column meet, its cells don't.
    before = F.coalesce(F.sum("n").over(Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    needed = table(counts.where("n > 0").withColumn("before", before).where(F.col("before") < k).select("column_name", "part", "before"), "first-parts")
    last = needed.agg(F.max("part")).first()[0]
    head = df.where(named(place) < (((last if last is not None else -1) + 1) << POSITION_BITS))
    cells = head.select(named(place).alias("at"), part.alias("part"), F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), v.alias("value")) for c, v in values.items())))).where("value is not null")
    # At most k parts a column.
    near = cells.join(F.broadcast(needed), ["column_name", "part"])
    ranked = near.withColumn("own", F.row_number().over(Window.partitionBy("column_name", "part").orderBy("at"))).where(F.col("own") <= k)
    return ranked.select("column_name", (F.col("before") + F.col("own")).cast("int").alias("position"), "value").where(F.col("position") <= k)
