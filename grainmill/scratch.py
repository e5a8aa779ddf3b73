"""Tables that cut a lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in local tests.
OWN_SHARED_DIR = "/tmp/checkpoints/grainmill"

_TOPS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: what ``spark.checkpoint.dir`` names, else the session's checkpoint folder; only a local session may go without either."""
    context = spark.sparkContext
    given = context._jsc.sc().getCheckpointDir()
    folder = spark.conf.get("spark.checkpoint.dir", None) or (None if given.isEmpty() else str(given.get()))
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that the driver and all executors share")
        folder = OWN_SHARED_DIR
    if given.isEmpty():
        context.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    top = _TOPS.get(spark.sparkContext.applicationId)
    if top is None:
        top = f"{shared_dir(spark).rstrip('/')}/grainmill-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _TOPS[spark.sparkContext.applicationId] = top
    return f"{top}/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a lost executor costs none of it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
