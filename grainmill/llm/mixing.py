"""Mixing sources to target weights by hash thresholds, found from histograms instead of a sort.

Every document has a fixed 60-bit hash.  A source that gets r times its words takes each document floor(r) times, and
once more if its hash is not above the source's threshold; a greater budget has a greater threshold, so takes are nested.
Thresholds come from sums by source and the hash's leading 12 bits: the bucket in which the budget runs out is refined
by the next 12 bits, over its own documents alone, until it holds one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rows import fresh, with_row_index
from .common import small, table

#: Weights of the sources by code point, repeating; most that a source may repeat.
WEIGHTS = (5, 2, 1)
MOST = 3
BITS, STEP = 60, 12
#: Sources whose plan may be broadcast.
MAX_BROADCAST_SOURCES = 20_000


def draw(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The document's hash: the first 60 bits of the MD5 of its id as text, a colon and its text; the empty text stands for null.

    Rows of one id, or without one, are drawn apart where their texts differ.
    """
    whole = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, BITS // 4), 16, 10).cast("bigint")


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    The sum of all sizes is shared by weight; a share stops at ``most`` times its source, and what is above it is shared
    again among the others: target = least(level x weight, cap), where the level rises until no more source is above its
    cap.  Each step is one aggregate over the sources.  Sources are numbered by ranges, so there may be any number of them.
    """
    ranked = with_row_index(sizes, "__rank", (F.col("source").asc_nulls_last(),))
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.col("__rank") - 1, F.lit(len(weights))))
    capped = table(ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap")), "mix-caps")
    total = capped.agg(F.sum("source_size").cast("double")).first()[0] or 0.0
    level, closed = 0.0, -1
    while True:
        above = F.lit(level) * F.col("w") > F.col("cap") if closed >= 0 else F.lit(False)
        now = capped.agg(F.count_if(above).alias("closed"), F.sum(F.when(above, F.col("cap"))).alias("caps"), F.sum(F.when(~above, F.col("w"))).alias("open")).first()
        if now.closed == closed or not now.open:
            break
        level, closed = (total - (now.caps or 0.0)) / now.open, now.closed
    return capped.select("source", "source_size", F.least(F.lit(level) * F.col("w"), F.col("cap")).alias("target"))


def plan(sized: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, full, threshold) from (source, size, draw): one row for each source."""
    goals = table(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "mix-targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    goals = goals.withColumn("full", full).withColumn("budget", F.col("target") - F.col("full") * F.col("source_size"))
    n = goals.count()
    state = goals.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("before"))
    done: list[DataFrame] = []
    for shift in range(BITS - STEP, -1, -STEP):
        near = small(state, n, MAX_BROADCAST_SOURCES)
        rows = sized.alias("d").join(near.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("d.draw", shift + STEP) == F.col("s.prefix")))
        sums = rows.groupBy(F.col("s.source").alias("source"), "budget", "before", F.shiftright("d.draw", shift).alias("bucket")).agg(F.sum("size").alias("w"), F.min("draw").alias("low"), F.max("draw").alias("high"))
        upto = F.col("before") + F.sum("w").over(Window.partitionBy("source", "budget", "before").orderBy("bucket"))
        over = sums.withColumn("upto", upto).where("upto > budget").groupBy("source", "budget").agg(F.min(F.struct("bucket", "upto", "w", "low", "high")).alias("m"))
        edge = table(over.select("source", "budget", F.col("m.bucket").alias("prefix"), (F.col("m.upto") - F.col("m.w")).alias("before"), F.col("m.upto").alias("upto"), F.col("m.low").alias("low"), F.col("m.high").alias("high")), "mix-boundaries")
        # One hash left: it is taken if that comes nearer to the budget.
        nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("before")
        done.append(edge.where("low = high").select("source", F.when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("threshold")))
        state = edge.where("low < high").select("source", "budget", "prefix", "before")
        if state.isEmpty():
            break
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    # Without a boundary the budget is not less than all that the source has.
    return table(
        goals.alias("g").join(found.alias("f"), F.col("g.source").eqNullSafe(F.col("f.source")), "left")
        .select("g.source", "source_size", "target", "full", F.coalesce("threshold", F.when(F.col("budget") > 0, F.lit((1 << BITS) - 1)).otherwise(F.lit(-1))).cast("bigint").alias("threshold")),
        "mix-plan",
    )


def times(draw_: Column, most: int = MOST, of: str = "p") -> Column:
    """How often the mix takes a document, given its source's plan; never more than ``most`` times, as an empty document below the threshold of a source at its cap would be."""
    return F.least(F.col(f"{of}.full") + F.when(draw_ <= F.col(f"{of}.threshold"), 1).otherwise(0), F.lit(most))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, draw) of every document."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), draw(id_col, text_col).alias("draw"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken), one row for each row of ``docs``.

    A null text has size 0; a null source is a source of its own, the last.  Rows alike in id and text have one hash and
    are taken alike; all others are drawn apart.  A source's taken words miss its target by half the words of the rows that
    share its boundary hash at most, which is half a document where no row repeats.  Reruns agree.  An empty table gives no
    rows.
    """
    sized = table(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    made = plan(sized, weights, most)
    of = small(made, made.count(), MAX_BROADCAST_SOURCES).alias("p")
    return sized.alias("d").join(of, F.col("d.source").eqNullSafe(F.col("p.source"))).select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("draw"), most)).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself: the rows of ``docs`` with their columns, each as often as it is taken, ``most`` times at most.

    The texts are not shuffled if the plan is small.  Null and empty texts have no words and are taken as their hash says;
    a null source is a source of its own; rows alike in id and text are taken alike; an empty table gives no rows.  Columns
    of ``docs`` may have any names.
    """
    made = plan(table(sizes(docs, id_col, text_col, source_col), "mix-sizes"), weights, most)
    of = small(made.select("source", "full", "threshold"), made.count(), MAX_BROADCAST_SOURCES).alias("p")
    copies, (copy,) = times(draw(f"d.{id_col}", f"d.{text_col}"), most), fresh(docs, "__copy")
    joined = docs.alias("d").join(of, F.col(f"d.{source_col}").cast("string").eqNullSafe(F.col("p.source")))
    return joined.select("d.*", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias(copy)).drop(copy)
