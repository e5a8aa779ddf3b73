"""Token ids as flat files: unsigned integers end to end, 64-bit offsets of documents beside them.

A data set is a folder of shards in ascending order of document ids.  Shard s has three files::

    tokens-s.bin    ids of all its documents, little-endian, 16 bits if the vocabulary allows it, else 32
    offsets-s.bin   n + 1 unsigned 64-bit numbers: where each document starts within the shard, and the shard's length
    docs-s.bin      n signed 64-bit document ids

The shards' bases are prefix sums of their lengths.  Files are mapped into memory where they are read.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, utf8
from .tokens import UnitEncoder, worker

#: The rows are dealt and written in this many turns, each over a range of ids, so that only a part of the text is in
#: shuffle files at once.
TURNS = 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MANIFEST = "shard int, n_docs bigint, n_nulls bigint, n_tokens bigint"


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that Spark names; the path within it."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def _shuffles_end(spark: SparkSession):
    """Shuffle files go as soon as the query that made them ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def _writer(folder: str, tokenizer: str, end_id: int | None):
    def write(name: str, store: pafs.FileSystem, top: str, attempt: str):
        return store.open_output_stream(f"{top}/.{name}.{attempt}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition has the rows of one shard, sorted.  A repeated attempt writes the same bytes under a name of its own and then renames."""
        coder = worker(UnitEncoder, tokenizer)
        tail = b"" if end_id is None else np.array([end_id], coder.dtype).tobytes()
        store, top = _place(folder)
        attempt, shard, out = uuid.uuid4().hex, None, None
        ids, lengths, nulls = [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if shard is None:
                shard = batch.column("shard")[0].as_py()
                out = write(f"tokens-{shard:06d}.bin", store, top, attempt)
            own = batch.column("doc_id")
            nulls += own.null_count
            ids.append(own.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            for text in batch.column("text"):
                data = coder.encode(text.as_buffer().to_pybytes()) + tail
                lengths.append(len(data) // coder.dtype.itemsize)
                out.write(data)
        if shard is None:
            return
        out.close()
        offsets = np.zeros(len(lengths) + 1, "<u8")
        np.cumsum(lengths, out=offsets[1:])
        for name, data in ((f"offsets-{shard:06d}.bin", offsets), (f"docs-{shard:06d}.bin", np.concatenate(ids))):
            with write(name, store, top, attempt) as f:
                f.write(data.tobytes())
        for name in ("tokens", "offsets", "docs"):
            store.move(f"{top}/.{name}-{shard:06d}.bin.{attempt}", f"{top}/{name}-{shard:06d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), *(pa.array([int(x)], pa.int64()) for x in (len(lengths), nulls, offsets[-1]))], names=["shard", "n_docs", "n_nulls", "n_tokens"])

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", turns: int = TURNS) -> pd.DataFrame:
    """Writes the data set and returns its manifest: one row a shard with its base.

    ``folder`` is new and shared by the driver and all executors.  Documents stand in ascending order of ids, null ids
    first; equal ids stand side by side, spread over several shards by their texts if they are many.  A null or empty text has no ids but the end id.  Shards are cut at quantiles of the
    ids, so no document is sorted or kept whole outside its shard.  An empty table gives a manifest without rows.
    """
    spark = docs.sparkSession
    store, top = _place(folder)
    store.create_dir(top, recursive=True)
    wanted = max(turns, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"))
    seen = rows.agg(F.percentile_approx("doc_id", [i / wanted for i in range(1, wanted)], 10 * wanted).alias("cuts"), F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = seen.cuts or []
    # Rows without an id take as many shards of their own, the first ones, as is their share.
    first = -(-seen.nulls * wanted // seen.n) if seen.nulls else 0
    # A document's shard: how many cuts lie below it.  Rows of one id that holds several cuts are spread over them.
    below, upto, null = _rank(cuts, strict=True), _rank(cuts, strict=False), F.col("doc_id").isNull()
    spread = lambda n: F.pmod(F.xxhash64("text"), n)
    rows = rows.withColumn("shard", F.when(null, spread(F.lit(max(first, 1)))).otherwise(first + below + spread(F.greatest(upto - below, F.lit(1)))).cast("int"))
    bounds = [round(t * (first + wanted) / turns) for t in range(turns + 1)]
    found = []
    with _shuffles_end(spark):
        for low, high in zip(bounds, bounds[1:]):
            own = rows.where(_range(cuts, low - first, high - first) | null if low < first else _range(cuts, low - first, high - first)).where(F.col("shard").between(low, high - 1))
            dealt = own.repartitionById(high - low, F.col("shard") - low).sortWithinPartitions("doc_id")
            found += dealt.select("shard", "doc_id", "text").mapInArrow(_writer(folder, tokenizer, end_id), MANIFEST).collect()
    manifest = pd.DataFrame([r.asDict() for r in found], columns=["shard", "n_docs", "n_nulls", "n_tokens"]).sort_values("shard", ignore_index=True).astype("int64")
    manifest["base"] = manifest["n_tokens"].cumsum() - manifest["n_tokens"]
    return manifest


def _rank(cuts: list[int], strict: bool):
    """How many sorted cuts lie below the id (strict) or at it or below: a tree of comparisons, as deep as the logarithm."""

    def tree(low: int, high: int):
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        ahead = F.col("doc_id") > F.lit(int(cuts[mid])) if strict else F.col("doc_id") >= F.lit(int(cuts[mid]))
        return F.when(ahead, tree(mid + 1, high)).otherwise(tree(low, mid))

    return tree(0, len(cuts))


def _range(cuts: list[int], low: int, high: int):
    """Bounds on the id that hold for every row of shards low to high - 1 (counted without those of null ids); the scan can skip row groups by them."""
    if not cuts:
        return F.lit(True)
    held = F.lit(True)
    if low > 0:
        held &= F.col("doc_id") >= F.lit(int(cuts[low - 1]))
    if high <= len(cuts):
        held &= F.col("doc_id") <= F.lit(int(cuts[max(high, 1) - 1]))
    return held


def map_file(folder: str, name: str, dtype) -> np.ndarray:
    """A file as an array: mapped into memory if the folder is local to the machine, else read."""
    store, top = _place(folder)
    if isinstance(store, pafs.LocalFileSystem):
        path = f"{top}/{name}"
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    with store.open_input_file(f"{top}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(spark: SparkSession, folder: str, manifest: pd.DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts ids over the whole data set."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dtype = worker(UnitEncoder, tokenizer).dtype
        for frame in frames:
            for s in frame.itertuples():
                offsets, docs = map_file(folder, f"offsets-{s.shard:06d}.bin", "<u8").astype(np.int64), map_file(folder, f"docs-{s.shard:06d}.bin", "<i8")
                tokens = map_file(folder, f"tokens-{s.shard:06d}.bin", dtype)
                for at in range(0, len(docs), 1 << 14):
                    o = offsets[at : at + (1 << 14) + 1]
                    crc = [zlib.crc32(tokens[a:b].astype("<u4").tobytes()) for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
                    own = pd.array(docs[at : at + (1 << 14)], "Int64")
                    own[: max(0, s.n_nulls - at)] = pd.NA
                    yield pd.DataFrame({"doc_id": own, "start": s.base + o[:-1], "n_tokens": np.diff(o), "ids_crc32": np.array(crc, np.int64)})

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    if manifest.empty:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame([tuple(map(int, r)) for r in manifest[["shard", "n_nulls", "base"]].itertuples(index=False)], "shard bigint, n_nulls bigint, base bigint")
    return shards.repartition(len(manifest)).mapInPandas(run, schema)


def token_files(docs: DataFrame, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes ``docs`` to ``folder`` (by default a new one in the shared folder) and reads the files back."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    return read_token_files(docs.sparkSession, folder, write_token_files(docs, folder, tokenizer, end_id, id_col, text_col), tokenizer)
