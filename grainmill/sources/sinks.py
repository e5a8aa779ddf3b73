"""Artifacts of a run: converted table, trace and manifest.  A folder's versions are a log of numbered manifests."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import ColumnConfig, InvalidRequest, Options
from ..functions.text import quoted
from ..operators.convert import export
from ..operators.issues import Issue, summary
from ..operators.trace import trace
from . import store

#: Fixed value: rows of a row group; the log's folder.
ROW_GROUP_ROWS = 100_000
LOG = "_versions"
#: The column of each table that has the row's number.
INDEX = {"converted": "_row_index", "trace": "row_index"}


def publish(converted: DataFrame, columns: dict[str, ColumnConfig], options: Options, folder: str, quality: dict[str, Any], issues: list[Issue], checksum: str | None = None, single_file: bool = False, buckets: int | None = None) -> dict[str, str]:
    """Writes the table, the trace and the next version of the folder, whose manifest says where they are.

    The tables go to a folder of a new name below ``folder`` and are never moved.  Then the manifest is put into the log
    under the next number, if no other writer has taken it meanwhile, else under the one after: of writers at the same time
    each has a version of its own.  Whoever reads the log finds whole tables of one run, after a crash at any step too, as
    nothing refers to tables without a manifest; former versions stay readable.  manifest.json is a copy of the last one.
    ``converted`` comes from ``convert(..., keep_raw=True)``; it is computed once for each table, so callers that have a dear
    plan write it first.  ``single_file`` writes each table as one file, for small results alone.

    With ``buckets`` both tables lie in that many files by the hash of the row's number, each sorted by it: what ``tables``
    opens is joined by row number without a shuffle, and a row is looked up in one row group of one file.  That costs one
    shuffle of each table here.  A bucket is to be some hundred MB, so a run over 100 TB takes some hundred thousand.
    """
    spark, top, own = converted.sparkSession, folder.rstrip("/"), f"run-{uuid.uuid4().hex}"
    tables = {"converted": export(converted, columns, options), "trace": trace(converted, columns, options.trace_mode)}
    for name, df in tables.items():
        placed = df.repartition(buckets, INDEX[name]) if buckets else df.coalesce(1) if single_file else df
        writer = placed.write.option("compression", "zstd").option("parquet.block.row.count.limit", str(ROW_GROUP_ROWS))
        if buckets:
            # Bucketed files are written through the catalog, which forgets them at once; the files stay, as the table is external.
            entry = _new_name()
            writer.option("path", f"{top}/{own}/{name}.parquet").bucketBy(buckets, INDEX[name]).sortBy(INDEX[name]).saveAsTable(entry)
            spark.sql(f"DROP TABLE {entry}")
        else:
            writer.parquet(f"{top}/{own}/{name}.parquet")
    manifest = {
        "source_checksum": checksum,
        "quality_summary": quality,
        "issue_summary": summary(issues),
        "spark_version": spark.version,
        "buckets": buckets,
        "artifacts": {name: f"{own}/{name}.parquet" for name in tables} | {"manifest": "manifest.json"},
    }
    number = max(versions(spark, folder), default=0) + 1
    while not store.put_if_absent(spark, _entry(top, number), _shown(manifest | {"version": number})):
        number += 1
    beside = f"{top}/{own}/manifest.json"
    store.write_text(spark, beside, _shown(manifest | {"version": number}))
    store.move(spark, beside, f"{top}/manifest.json")
    return artifacts(spark, folder, number)


def _new_name() -> str:
    return f"grainmill_{uuid.uuid4().hex}"


def _manifest(spark: SparkSession, entry: str) -> dict[str, Any]:
    return json.loads(store.read_text(spark, entry))


def _shown(manifest: dict[str, Any]) -> str:
    return json.dumps(manifest, sort_keys=True, indent=2, ensure_ascii=True, default=str)


def _entry(top: str, number: int) -> str:
    return f"{top}/{LOG}/{number:020d}.json"


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the folder's versions, in order."""
    log = f"{folder.rstrip('/')}/{LOG}"
    return [int(f.rsplit("/", 1)[1][:-5]) for f in store.files(spark, log, ".json")] if store.exists(spark, log) else []


def artifacts(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, str]:
    """The paths of the tables and the manifest of a version of ``folder``, the last one without a number."""
    top, known = folder.rstrip("/"), versions(spark, folder)
    if not known or version is not None and version not in known:
        raise InvalidRequest(f"{folder} has no version {version or 1}")
    entry = _entry(top, known[-1] if version is None else version)
    found = _manifest(spark, entry)["artifacts"]
    return {name: f"{top}/{path}" for name, path in found.items() if name != "manifest"} | {"manifest": entry if version is not None and version != known[-1] else f"{top}/manifest.json"}


def tables(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """The converted table and the trace of a version; if they lie in buckets, Spark knows it.

    A catalog entry is needed while a DataFrame is made and is dropped then; of an external table that leaves the files alone.
    """
    paths = artifacts(spark, folder, version)
    buckets = _manifest(spark, paths["manifest"]).get("buckets")
    return {name: _bucketed(spark, paths[name], key, buckets) if buckets else spark.read.parquet(paths[name]) for name, key in INDEX.items()}


def _bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    entry, schema = _new_name(), spark.read.parquet(path).schema
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {entry} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
    try:
        return spark.table(entry)
    finally:
        spark.sql(f"DROP TABLE {entry}")
