"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A test item is contained in a document to the degree that its distinct shingles are among the document's.  Items are
partitioned by their number of shingles (powers of two).  An item's signature is its bottom-k MinHash: the k shingles of
least hash, with k over the share that a match may lack, at its partition's upper size.  So a document that holds enough
of an item holds a signature shingle of it, however long the document is; each document's shingles are looked up in the
index of signatures, and the items found are verified by counting all their shingles.  No match is lost.

An item of fewer words than a shingle is one shingle, its whole sequence of words; documents' runs of that length are
looked up beside the others.  An item without words matches nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, utf8, window_hashes, word_hashes

WIDTH, SIMILARITY = 5, Fraction(4, 5)
#: Items (and bytes of their texts) that go to the executors at once; a larger benchmark is searched in blocks of this size.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32 << 20

#: ASCII letters and digits, lower-cased, and bytes of other characters; all else parts words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORD_BYTES).split()


def shingles(found: list[bytes], width: int = WIDTH) -> set[bytes]:
    return {b" ".join(found[i : i + width]) for i in range(len(found) - width + 1)}


class Index:
    """Signatures of a block of items by width of shingle, by hashes that hold within one process."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int = WIDTH, similarity: Fraction = SIMILARITY):
        self.similarity = similarity
        self.items: list[tuple[int | None, set[bytes], int]] = []
        by_width: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, data in items:
            own = words(data)
            wide = min(width, len(own))
            hashes = np.unique(window_hashes(word_hashes(own), wide)) if own else ()
            n = len(hashes)
            if not n:
                continue
            upper = (1 << n.bit_length()) - 1  # the partition's largest size
            k = min(n, int((1 - similarity) * upper) + 1)
            for h in hashes[:k].tolist():
                by_width[wide][h].append(len(self.items))
            self.items.append((item_id, shingles(own, wide), wide))
        self.parts = [(wide, dict(found), *_filter(found)) for wide, found in sorted(by_width.items())]

    def search(self, data: bytes) -> list[tuple[int | None, int, int]]:
        """(item_id, its shingles, those that the document shares) of each item that is contained."""
        if not self.parts:
            return []
        found = words(data)
        hashed, candidates = word_hashes(found), set()
        for wide, by_hash, keys, bits in self.parts:
            hashes = window_hashes(hashed, wide)
            hashes = hashes[bits[(hashes >> np.uint64(44)).astype(np.int64)]]
            if len(hashes):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                candidates.update(i for h in np.unique(hashes[keys[at] == hashes]).tolist() for i in by_hash[h])
        own = {wide: shingles(found, wide) for wide in {self.items[i][2] for i in candidates}}
        out = []
        for i in sorted(candidates):
            item_id, needed, wide = self.items[i]
            shared = len(needed & own[wide])
            if shared >= self.similarity * len(needed):
                out.append((item_id, len(needed), shared))
        return out


def _filter(by_hash) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes, and which of their leading 20 bits occur."""
    keys = np.array(sorted(by_hash), np.uint64)
    bits = np.zeros(1 << 20, bool)
    bits[(keys >> np.uint64(44)).astype(np.int64)] = True
    return keys, bits


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.toLocalIterator():
        block.append((row[0], bytes(row[1])))
        size += len(row[1])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(width: int, similarity: Fraction, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, width, similarity)
        for batch in batches:
            rows = [(d, *x) for d, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for x in index.search(text.as_py())]
            d, i, n, s = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (d, i, n, s)], names=["doc_id", "item_id", "n_shingles", "n_shared"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment): one row for each row of ``docs`` and item it contains.

    Shingles are runs of ``width`` words; words are ASCII letters and digits, lower-cased, and other characters, so
    marks and line breaks play no part.  An item of fewer words is one shingle and matches where its words stand side by
    side; a null or empty item or text matches nothing.  Repeated items and repeated rows match each for itself.  Whole texts are searched where they are read,
    once for each block of items; nothing is shuffled and no row or item is left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    schema = "doc_id bigint, item_id bigint, n_shingles bigint, n_shared bigint"
    out = None
    for block in _blocks(benchmark.select(F.col(item_col).cast("bigint"), utf8(item_text_col))):
        found = rows.mapInArrow(_search(width, similarity, spark.sparkContext.broadcast(block)), schema)
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns; texts are judged where they are.

    A null or empty text contains nothing and stays; repeated rows stay or go together; an empty benchmark keeps all rows,
    an empty table gives none.  A worker holds one block of items: between blocks the rows that are left are written to
    the shared folder, so a larger benchmark costs more passes but no more memory.
    """
    context, sent = docs.sparkSession.sparkContext, None
    for block in _blocks(benchmark.select(F.col(item_col).cast("bigint"), utf8(item_text_col))):
        if sent is not None:
            docs = table(docs, "decontaminated")
            sent.unpersist()
        sent = context.broadcast(block)
        docs = docs.where(~_contains(sent, width, similarity)(utf8(text_col)))
    return docs


def _contains(sent, width: int, similarity: Fraction):
    made: list[Index] = []

    @F.pandas_udf("boolean")
    def contains(texts):
        if not made:
            made.append(Index(sent.value, width, similarity))
        return texts.map(lambda x: bool(made[0].search(x or b"")))

    return contains
