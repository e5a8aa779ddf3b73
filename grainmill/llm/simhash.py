"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into three blocks of 22, 21 and 21 bits.  If two fingerprints differ in at most four bits,
some pair of blocks holds at most two of them (each block is in two of the three pairs, so the least pair holds at most
two thirds).  For each pair of blocks the anchors are the code words of the product of two binary Golay codes: a perfect
code whose spheres of radius 3 cover the space of 23 bits (shorter blocks are padded by zeros).  A fingerprint is
replicated to every anchor that covers a point within half the pair's threshold of it, here one bit: fingerprints two
bits apart have a point halfway, whose anchor gets both.  That is at most 11 anchors a pair and 33 in all, out of some
four million anchors a pair.

Exact copies share a fingerprint and are one node.  Anchors with very many fingerprints are cut into cells, each pair of
cells compared in a task of its own, and a cell yields the links of a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rows import fresh
from .common import LOWER, checkpoint, table, utf8
from .components import connected_components

BITS = (22, 21, 21)
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Largest number of differing bits that the cut into blocks and the replication cover.
MAX_BITS = 4
#: Most fingerprints in a cell of an anchor.
CELL = 2048
#: Shingles hashed at once, so that a huge document needs bounded memory.
CHUNK = 1 << 16


def fingerprint(data: bytes, width: int = 4, seed: int = 42) -> int:
    """The fingerprint of a UTF-8 text, unsigned; zero if it has no word."""
    words = data.translate(LOWER).split()
    if not words:
        return 0
    text = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(width, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        s, e = starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist()
        hashes = np.fromiter((digest(text[i:j], seed) for i, j in zip(s, e)), np.uint64, len(s))
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * votes > len(starts)).tolist())


def _fingerprints(width: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed bigint, one row for each row of ``docs``; a null text has no words."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    return rows.mapInArrow(_fingerprints(width, seed), "doc_id bigint, fp bigint")


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and high 11 bits by the generator polynomial, and the error that each remainder stands for."""
    poly, single = 0xC75, []
    for i in range(23):
        x = 1 << i
        for j in range(i, 10, -1):
            if x >> j & 1:
                x ^= poly << (j - 11)
        single.append(x)
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for i in range(12):
        low[1 << i : 2 << i] = low[: 1 << i] ^ single[i]
    for i in range(11):
        high[1 << i : 2 << i] = high[: 1 << i] ^ single[12 + i]
    error = np.zeros(1 << 11, np.int64)
    for i in range(23):
        error[single[i]] = 1 << i
        for j in range(i):
            error[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                error[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return low, high, error


_LOW, _HIGH, _ERROR = _golay()


def _nearest(x: np.ndarray) -> np.ndarray:
    """The code word whose sphere covers each 23-bit value."""
    return x ^ _ERROR[_LOW[x & 0xFFF] ^ _HIGH[x >> 12]]


def _anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, index into fps) of every replica."""
    u = fps.view(np.uint64)
    home, around, shift = [], [], 0
    for bits in BITS:
        x = (u >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        shift += bits
        own = _nearest(x)
        near = np.sort(np.stack([own, *(_nearest(x ^ (1 << i)) for i in range(bits))]), axis=0)
        new = np.ones(near.shape, bool)
        new[1:] = near[1:] != near[:-1]
        new &= near != own
        which = np.nonzero(new)
        home.append(own)
        around.append((which[1], near[which]))
    keys, at = [], []
    every = np.arange(len(fps))
    for number, (a, b) in enumerate(PAIRS):
        tag = number << 46
        keys += [tag | home[a] << 23 | home[b], tag | around[a][1] << 23 | home[b][around[a][0]], tag | home[a][around[b][0]] << 23 | around[b][1]]
        at += [every, around[a][0], around[b][0]]
    return np.concatenate(keys), np.concatenate(at)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.ascontiguousarray(batch.column("fp").to_numpy(zero_copy_only=False))
        for i in range(0, len(fps), 1 << 14):
            keys, at = _anchors(fps[i : i + (1 << 14)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[i : i + (1 << 14)][at])], names=["anchor", "fp"])


def _forest(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one cell: each step compares one fingerprint with those not reached yet."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = np.bitwise_count(rest ^ x) <= bits
            found = rest[hit]
            if len(found):
                out += [(x, y) for y in found]
                queue += list(found)
                rest = rest[~hit]
    return out


def _compare(bits: int):
    def links(key: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        left, right = [], []
        few = np.repeat(np.where(sizes <= 8, sizes, 0), sizes)
        place = np.arange(len(key)) - np.repeat(starts, sizes)
        for d in range(1, 8):
            i = np.flatnonzero(place + d < few)
            i = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= bits]
            left.append(fps[i])
            right.append(fps[i + d])
        for s, n in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist()):
            if pairs := _forest(np.unique(fps[s : s + n]), bits):
                left.append(np.array([a for a, _ in pairs], np.uint64))
                right.append(np.array([b for _, b in pairs], np.uint64))
        a, b = np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and cell; the last group of a batch waits for the next batch."""
        anchors, fps = np.empty(0, np.complex128), np.empty(0, np.uint64)
        for batch in batches:
            anchor, cell = batch.column("anchor").to_numpy(), batch.column("cell").to_numpy()
            key = np.empty(len(anchor), np.complex128)  # both numbers stay below 2 ** 53
            key.real, key.imag = anchor, cell
            anchors = np.concatenate([anchors, key])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            if len(anchors) and (cut := int(np.argmax(anchors == anchors[-1]))):
                yield from links(anchors[:cut], fps[:cut])
                anchors, fps = anchors[cut:], fps[cut:]
        if len(anchors):
            yield from links(anchors, fps)

    return run


def links(prints: DataFrame, bits: int = MAX_BITS, cell: int = CELL) -> DataFrame:
    """(a, b), a > b: links between distinct fingerprints (column fp) that differ in ``bits`` or fewer bits.

    Links within an anchor are those of a spanning forest, so components are whole though not every pair is named.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"this covering reaches {MAX_BITS} differing bits")
    replicas = prints.select("fp").mapInArrow(_replicate, "anchor bigint, fp bigint")
    hot = table(replicas.groupBy("anchor").count().where(F.col("count") > cell).select("anchor", F.ceil(F.col("count") / cell).cast("int").alias("cells")), "hot-anchors")
    if hot.isEmpty():
        dealt = replicas.withColumn("cell", F.lit(0).cast("bigint"))
    else:
        # A hot anchor's rows go to every pair of cells that holds theirs; two fingerprints meet in the pair of their cells.
        own, other, wide = F.pmod(F.xxhash64("fp"), F.col("cells")), F.col("other"), 1 << 26
        dealt = (
            replicas.join(hot, "anchor", "left")
            .withColumn("cells", F.coalesce("cells", F.lit(1)))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            .select("anchor", "fp", (F.least(own, other) * wide + F.greatest(own, other)).cast("bigint").alias("cell"))
        )
    sorted_ = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    return sorted_.select("anchor", "cell", "fp").mapInArrow(_compare(bits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    component_id is the least id reachable over links of ``bits`` or fewer differing bits.  Null and blank texts have the
    fingerprint zero and link like any other; copies and repeated rows share a fingerprint; a row whose id is null gets
    its component's least id, null if there is none.  An empty table gives no rows.
    """
    prints = table(fingerprints(docs, id_col, text_col, width, seed), "fingerprints")
    nodes = table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    reached = connected_components(links(nodes, bits))
    named = checkpoint(nodes.join(reached, nodes.fp == reached.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = table(named.join(least, "component").select("fp", "component_id"), "components")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` with all their columns, one of each group of near-duplicates: the one with the least id.

    Null ids come last.  Rows with the same id and the same text are one row; of rows with one id but different texts in
    one group, the one whose text has the least hash stays.  The other rows are dropped by a join on the id and the text's
    hash, so the documents are shuffled at most once.
    """
    docs, key, rows = keyed(docs, id_col, text_col)
    marked = rows.select(F.struct("id", "__key").alias("row"), "text")
    prints = table(_with_row(marked, width, seed), "fingerprints")
    nodes = table(prints.groupBy("fp").agg(least_row(), F.count("*").alias("n")), "distinct-fingerprints")
    return one_of_each(docs, key, prints, nodes.withColumnRenamed("fp", "own"), links(nodes, bits))


def least_row():
    """The row that stays of those with columns id and key."""
    return F.min(F.struct(F.col("id").isNull().alias("no"), "id", "key")).alias("least")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, DataFrame]:
    """``docs`` with one more column, a key of id and text; that column's name, as no other column is called; and (id, text, __key) of the rows."""
    own = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    (key,) = fresh(docs, "__key")
    docs = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("bigint"), own))
    return docs, key, docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.col(key).alias("__key"))


def one_of_each(docs: DataFrame, key: str, prints: DataFrame, nodes: DataFrame, linked: DataFrame) -> DataFrame:
    """The ``docs`` keyed by the column ``key`` that are the least of their component, without it; ``prints`` has each row's key, ``nodes`` columns own and least."""
    reached = connected_components(linked)
    named = checkpoint(nodes.join(reached, nodes.own == reached.node, "left").select("least", F.coalesce("component", "own").alias("component")))
    kept = table(named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.key").alias(key)), "kept-documents")
    out = docs.join(kept, key, "left_semi")
    if prints.groupBy("key").count().where("count > 1").join(kept.withColumnRenamed(key, "key"), "key", "left_semi").isEmpty():
        return out.drop(key)
    return out.dropDuplicates([key]).drop(key)


def _with_row(marked: DataFrame, width: int, seed: int) -> DataFrame:
    """(id, key, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x.as_py(), width, seed) for x in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(prints.view(np.int64))], names=["id", "key", "fp"])

    return marked.select(F.col("row.id").alias("id"), F.col("row.__key").alias("key"), utf8("text").alias("text")).mapInArrow(run, "id bigint, key bigint, fp bigint")
