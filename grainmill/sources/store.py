"""Bytes through the session's Hadoop file systems, so that any path that Spark knows works."""

from __future__ import annotations

import posixpath
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..config import InvalidRequest, SourceError


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def prefix(spark: SparkSession, path: str, size: int = 4 << 20) -> bytes:
    """The first bytes of a file."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        raise SourceError(f"no such source: {path}")
    size = min(size, fs.getFileStatus(where).getLen())
    stream = fs.open(where)
    try:
        data = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)
    finally:
        stream.close()
    return bytes(data)


def length(spark: SparkSession, path: str) -> int:
    fs, where = _fs(spark, path)
    return fs.getFileStatus(where).getLen()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def _rename(spark: SparkSession, source: str, target: str, how: str) -> None:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    a, b = fs.makeQualified(a), fs.makeQualified(b)
    options = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, how)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(a, b, options)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames within a file system; a file at the target is replaced in the same step."""
    _rename(spark, source, target, "OVERWRITE")


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a whole file unless one stands there; says whether it did.  Half a file is never seen, as it is written beside and renamed."""
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, beside, text)
    try:
        _rename(spark, beside, path, "NONE")
        return True
    except Py4JJavaError as error:
        remove(spark, beside)
        if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
            raise
        return False


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def within(spark: SparkSession, path: str, roots) -> str:
    """The path with its file system and without '..'; raises InvalidRequest if it lies in none of the folders ``roots``."""

    def whole(x: str) -> str:
        fs, where = _fs(spark, x)
        uri = fs.makeQualified(where).toUri()
        return f"{uri.getScheme()}://{uri.getAuthority() or ''}{posixpath.normpath(uri.getPath())}"

    found = whole(path)
    if not any(found == r or found.startswith(r.rstrip("/") + "/") for r in map(whole, roots)):
        raise InvalidRequest(f"{path} lies outside the folders allowed")
    return found


def read_text(spark: SparkSession, path: str) -> str:
    """A small file whole."""
    return prefix(spark, path, length(spark, path)).decode("utf-8")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def files(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """The files of a folder with that ending, by name."""
    fs, where = _fs(spark, folder)
    return sorted(str(x.getPath().toString()) for x in fs.listStatus(where) if str(x.getPath().getName()).endswith(ending))
