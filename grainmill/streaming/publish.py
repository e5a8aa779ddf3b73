"""Streams to their end: converted tables and issue counts that are published once for each batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import ColumnConfig, InvalidRequest
from ..operators.rows import with_row_index
from ..sources import log
from .convert import convert_stream, issue_counts

#: The local property in which Spark names the query that runs a batch; it stays when the query starts anew from its checkpoint.
_QUERY_ID = "sql.streaming.queryId"


def _name(batch: int) -> str:
    return f"{batch:020d}"


def _start(df: DataFrame, mode: str, checkpoint: str, put: Callable[[DataFrame, int, str], None], trigger: dict) -> StreamingQuery:
    def run(batch: DataFrame, number: int) -> None:
        put(batch, number, batch.sparkSession.sparkContext.getLocalProperty(_QUERY_ID))

    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**trigger).start()


def publish_stream(raw: DataFrame, columns: dict[str, ColumnConfig], folder: str, checkpoint: str, tokens: Sequence[str] = (), sizes: dict[str, tuple[int, int]] | None = None, drop_empty: bool = True, trigger: dict | None = None) -> StreamingQuery:
    """Converts a stream and adds each batch to ``folder`` once, whatever fails between; ``log.read`` gives the whole table.

    Rows have a _row_index that goes on from the batch before: the log says how many rows stand before a batch, so a query
    that was stopped and starts anew from its checkpoint counts on.  The numbers follow the batch's partitions, and stand
    as written by the attempt that put the batch.  A folder belongs to one checkpoint; a query from another one fails.
    Empty batches add a table without rows.  ``trigger`` is as in ``writeStream.trigger``: all that is there, by default.
    """

    def put(batch: DataFrame, number: int, owner: str) -> None:
        spark = batch.sparkSession
        last = log.entry(spark, folder, _name(number - 1)) if number else None
        if number and last is None:
            raise InvalidRequest(f"{folder} has no batch {number - 1}; it is not the folder of this checkpoint")
        before = last["row_end"] if last else 0

        def made() -> DataFrame:
            indexed = with_row_index(convert_stream(batch, columns, tokens, sizes, drop_empty))
            return indexed.withColumn("_row_index", F.col("_row_index") + before)

        log.put_once(spark, folder, _name(number), owner, made, before)

    return _start(raw, "append", checkpoint, put, trigger or {"availableNow": True})


def publish_issue_counts(converted: DataFrame, event_time: str, folder: str, checkpoint: str, window: str = "1 hour", late: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Keeps rows and errors by window of event time in ``folder``; ``issue_counts_of`` reads them.

    Each batch adds the windows that it changed.  The state of a window goes once the newest event is ``late`` behind it;
    what comes later still isn't counted.
    """

    def put(batch: DataFrame, number: int, owner: str) -> None:
        log.put_once(batch.sparkSession, folder, _name(number), owner, lambda: batch.withColumn("batch", F.lit(number)))

    return _start(issue_counts(converted, event_time, window, late), "update", checkpoint, put, trigger or {"availableNow": True})


def issue_counts_of(spark: SparkSession, folder: str) -> DataFrame:
    """(window_start, row_count, error_count) as of the last batch that changed each window."""
    last = log.read(spark, folder).groupBy("window_start").agg(F.max_by(F.struct("row_count", "error_count"), "batch").alias("last"))
    return last.select("window_start", "last.*")
