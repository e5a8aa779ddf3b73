"""How filters interact: what each order of five filters removes, and each filter's fair share, from mask counts.

A document fails a set of filters, its mask.  Per part of the corpus the masks are counted in Spark; all else follows from
at most 32 counts a part.  With x_i = 1 where filter i is applied, the documents removed are the polynomial

    P(x) = sum over masks m of n_m (1 - product over i in m of (1 - x_i)),

linear in each x_i.  Its value at a corner is what a set of filters removes, so corners give what survives each step of each
order.  The integral of its partial derivative along the diagonal from no filters to all is the filter's Shapley value, the
mean of what it removes over all orders; it is computed with exact rationals and scaled by 120, the number of orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, utf8

#: A: few words, B: few distinct words, C: many capitals, D: symbols, E: a copy of a text with a smaller id.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
COPY = 1 << FILTERS.index("E")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Rows of labels that may be broadcast.
MAX_BROADCAST_LABELS = 1_000_000

_CAPITALS, _LATER_BYTES = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def failed(data: bytes) -> int:
    """The mask of the filters A to D that a text fails; words are runs of anything but U+0020 and U+0009 to U+000D."""
    words = data.split()
    a = len(words) < LEAST_WORDS
    b = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    c = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * len(data.translate(None, _LATER_BYTES))
    d = len(data) != len(data.translate(None, SYMBOLS))
    return a | b << 1 | c << 2 | d << 3


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, failed, digest) of each row: the mask without E, and the SHA-256 of the whole text.  A null text is empty, a null part the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            masks, digests = pa.array(map(failed, texts), pa.int32()), pa.array((hashlib.sha256(t).digest() for t in texts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], names=["doc_id", "part", "failed", "digest"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), utf8(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, part string, failed int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail, and those labelled good (quality 1) and toxic.

    Rows alike in id, part and text are counted together first, so neither a hot text nor a hot id brings many rows to one
    task; rows without an id are spread by their text, match no label and are no copies.  A copy is a row whose text stands
    under a smaller id, in any part.  Several labels of an id count as one that has what any of them has.
    """
    rows = measured(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "failed", "digest").agg(F.count("*").alias("n"))
    mark = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("of")).agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    spread = rows.withColumns({"has": F.col("doc_id").isNotNull(), "key": F.coalesce("doc_id", F.xxhash64("digest"))})
    known = spread.join(small(marks, marks.count(), MAX_BROADCAST_LABELS), F.col("has") & (F.col("key") == F.col("of")), "left")
    known = known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("has"), F.struct("doc_id", "n")))
    texts = known.groupBy("digest", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), least.alias("least"), F.sum(F.when(F.col("has"), 0).otherwise(F.col("n"))).alias("unnamed"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    original = F.col("unnamed") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    sides = texts.withColumn("first", first).withColumn("original", original)
    sides = sides.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("failed").alias("mask"), F.col("original").alias("n")), F.struct((F.col("failed") + COPY).alias("mask"), (F.col("n") - F.col("original")).alias("n")))).alias("s"))
    return sides.groupBy("part", "s.mask").agg(F.sum("s.n").alias("n"), *(F.sum(F.when(F.col(c), F.col("s.n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


class RemovalPolynomial:
    """Documents removed as a multilinear polynomial: ``terms[T]`` is the coefficient of the product of x_i over i in T."""

    def __init__(self, counts: dict[int, int], n_filters: int = len(FILTERS)):
        self.terms = {}
        for t in range(1, 1 << n_filters):
            over = sum(n for mask, n in counts.items() if mask & t == t)
            self.terms[t] = over if t.bit_count() % 2 else -over

    def corner(self, applied: int) -> int:
        """What the set of filters ``applied`` removes."""
        return sum(c for t, c in self.terms.items() if t & applied == t)

    def share(self, i: int) -> Fraction:
        """The integral over s of dP/dx_i at (s, ..., s): a term of k variables gives its coefficient times s^(k-1)."""
        return sum((Fraction(c, t.bit_count()) for t, c in self.terms.items() if t >> i & 1), Fraction(0))


def part_rows(counts: list[tuple[int, int, int, int]]) -> Iterator[dict]:
    """The rows of one part from its (mask, n, good, toxic)."""
    total, whole = sum(n for _, n, _, _ in counts), (1 << len(FILTERS)) - 1
    removal, good, toxic = (RemovalPolynomial({c[0]: c[k] for c in counts}) for k in (1, 2, 3))
    gone, good_gone, toxic_gone = ([p.corner(s) for s in range(whole + 1)] for p in (removal, good, toxic))
    shares = [removal.share(i) * factorial(len(FILTERS)) for i in range(len(FILTERS))]
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            i = FILTERS.index(letter)
            after = before | 1 << i
            removed = gone[after] - gone[before]
            yield {
                "filter_order": order, "step": step, "kept": total - gone[after], "removed": removed, "redundant": gone[1 << i] - removed, "unique_fails": gone[whole] - gone[whole ^ 1 << i],
                "good_lost": good_gone[after] - good_gone[before], "toxic_lost": toxic_gone[after] - toxic_gone[before], "shapley": int(shares[i]),
            }
            before = after


_COLUMNS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
_SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in _COLUMNS)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows for each part.

    Null and empty texts fail A alone; repeated rows count each for itself; an empty table has no parts and gives no rows.
    A part has 32 masks at most, so its counts are one small row, and parts are worked on apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                made = [{"part": row["part"]} | r for r in part_rows([(c["mask"], c["n"], c["good"], c["toxic"]) for c in row["counts"]])]
                yield pa.RecordBatch.from_pylist(made, pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *((c, pa.int64()) for c in _COLUMNS)]))

    counts = mask_counts(docs, labels, id_col, text_col, part_col)
    return counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts")).mapInArrow(run, _SCHEMA)
