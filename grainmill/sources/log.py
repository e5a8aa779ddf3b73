"""Tables that are added to a folder once each, under a number or a name, and found through the folder's log."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..config import InvalidRequest
from . import store

#: The folder of the entries, and what each holds: one line of JSON.
LOG = "_entries"
ENTRY = "name string, path string, owner string, row_count bigint, row_end bigint"


def _entry(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{LOG}/{name}.json"


def entry(spark: SparkSession, folder: str, name: str) -> dict[str, Any] | None:
    path = _entry(folder, name)
    return json.loads(store.read_text(spark, path)) if store.exists(spark, path) else None


def put_once(spark: SparkSession, folder: str, name: str, owner: str, make: Callable[[], DataFrame], before: int = 0) -> dict[str, Any]:
    """The entry ``name`` of the folder; if there is none, the table is made, written under a new path, counted, and put.

    An entry that is there is left alone, so that work repeated after a failure adds nothing; a table without an entry, as
    a crash leaves it, is never read.  Of two writers at once the first to put its entry counts.  An entry of another owner
    raises InvalidRequest.  ``before`` are the rows that stand before the table; the entry's row_end counts them too.
    """
    found = entry(spark, folder, name)
    if found is None:
        path = f"part-{name}-{uuid.uuid4().hex}.parquet"
        whole = f"{folder.rstrip('/')}/{path}"
        make().write.option("compression", "zstd").parquet(whole)
        n = spark.read.parquet(whole).count()
        said = {"name": name, "path": path, "owner": owner, "row_count": n, "row_end": before + n}
        found = said if store.put_if_absent(spark, _entry(folder, name), json.dumps(said)) else entry(spark, folder, name)
    if found["owner"] != owner:
        raise InvalidRequest(f"{folder} has {name} of {found['owner']}")
    return found


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """One row of ENTRY for each table of the folder, read by tasks."""
    if not store.exists(spark, f"{folder.rstrip('/')}/{LOG}"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{folder.rstrip('/')}/{LOG}")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All tables of the folder together.  The driver sees one path a table."""
    paths = [f"{folder.rstrip('/')}/{r.path}" for r in entries(spark, folder).select("name", "path").orderBy("name").collect()]
    if not paths:
        raise InvalidRequest(f"{folder} has no tables")
    return spark.read.parquet(*paths)
