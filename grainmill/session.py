"""Session settings that the operators rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    # The JVM compiles no method above 8,000 bytes of code; a larger one is to be cut into projections that it compiles.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Sets what may be set in a running session; a cluster's sizes and partition counts are left alone."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "grainmill") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.sql.shuffle.partitions", str(partitions)).config("spark.ui.enabled", "false")
    return configure(builder.getOrCreate())


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once an application, for sessions that were started without it on their path."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="grainmill-")
        with zipfile.ZipFile(f"{folder}/grainmill_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        context.addPyFile(f"{folder}/grainmill_package.zip")
        _SHIPPED.add(context.applicationId)
    return spark
