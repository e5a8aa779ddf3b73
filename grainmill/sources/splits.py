"""Records of one large file in many tasks, where a record's bounds depend on all that stands before it.

Spark's text reader deals a file to tasks by byte ranges and cuts each range at a separator: line ends for CSV, closing
braces for JSON.  Some of those cuts lie within quotes, within strings or within nested values.  Whether they do depends on
the state at the start of a range.  So a first scan finds, for each range and each kind of state it may start in, the state
it ends in and how many records end in it; a fold over these few rows gives the state at the start of every range and the
number of records before it, and a second scan puts the pieces of records together.  A record that reaches over ranges comes
in parts, two for each bound of ranges at most, which meet by the record's number.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SourceError

#: Records that a task sends on at a time.
BATCH = 5_000
#: Bits of a place that number the records that begin in one range.
PLACE_BITS = 33
#: A record whole in its range, its beginning, its end, or a part with neither.
WHOLE, BEGINNING, END, MIDDLE = 0, 1, 2, 3


class CsvState:
    """Whether a place lies within quotes: 0 or 1.  Quotes open at the start of a cell only, and a doubled one closes none."""

    #: A range may start in any of these states.
    starts = (0, 1)
    first = between = 0
    #: A record ends with a piece whose level is this.
    level = 0

    def __init__(self, delimiter: str = ",", encoding: str = "utf-8", separator: bytes = b"\n"):
        self.separator, self.delimiter = separator, delimiter.encode(encoding)
        self.opening = self.delimiter + b'"'

    def step(self, state: int, piece: bytes) -> tuple[int, int | None]:
        """The state behind a piece and its separator, and the level at which it ends something."""
        if b'"' in piece:
            state = self._quoted(state, piece)
        return state, None if state else 0

    def _quoted(self, state: int, line: bytes) -> int:
        at = 0
        if not state:
            at = 1 if line[:1] == b'"' else line.find(self.opening) + len(self.opening)
            if at < len(self.opening) and line[:1] != b'"':
                return 0
        while True:
            close = line.find(b'"', at)
            if close < 0:
                return 1
            if line[close + 1 : close + 2] == b'"':
                at = close + 2
                continue
            # Whatever stands between the closing quote and the next delimiter belongs to the cell.
            at = line.find(self.delimiter, close + 1)
            if at < 0:
                return 0
            at = line.find(self.opening, at)
            if at < 0:
                return 0
            at += len(self.opening)

    @staticmethod
    def kind(start: int) -> int:
        """Which of ``starts`` stands for a state."""
        return start

    @staticmethod
    def shift(start: int) -> int:
        """By how much levels in a range are moved that starts in this state."""
        return 0

    @staticmethod
    def after(start: int, end: int) -> int:
        """The state behind a range, from its start and the end as scanned from the start's kind."""
        return end


class JsonState:
    """The depth of brackets and whether a place lies within a string, as depth x 2 + 0 or 1.

    A range is scanned from depth 0, outside a string and within one; its real depth is added when it is known.  Levels are
    the depths behind closing braces; the objects of an array end at depth 1.
    """

    separator = b"}"
    starts = (0, 1)
    first, between, level = 0, 2, 1
    #: Behind a whole array, and the brace that is taken to stand behind the file's last piece.
    finish = -2

    @staticmethod
    def step(state: int, piece: bytes) -> tuple[int, int | None]:
        if b"\\" in piece:
            piece = piece.replace(b"\\\\", b"").replace(b'\\"', b"")
        depth, within = state >> 1, state & 1
        parts = piece.split(b'"')
        for part in parts[within::2]:
            if part:
                depth += part.count(b"{") + part.count(b"[") - part.count(b"]")
        within ^= 1 - len(parts) % 2
        return (depth << 1 | 1, None) if within else (depth - 1 << 1, depth - 1)

    @staticmethod
    def kind(start: int) -> int:
        return start & 1

    @staticmethod
    def shift(start: int) -> int:
        return start >> 1

    @staticmethod
    def after(start: int, end: int) -> int:
        return (start >> 1 << 1) + end


def pieces(spark: SparkSession, path: str, state) -> DataFrame:
    """(file, block, piece): the bytes between separators, in the order of the file within each range."""
    read = spark.read.option("lineSep", state.separator.decode()).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[bytes]]]:
    for batch in batches:
        keys = list(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist()))
        low = 0
        while low < len(keys):
            high = next((i for i in range(low + 1, len(keys)) if keys[i] != keys[low]), len(keys))
            yield keys[low], batch.column("piece").slice(low, high - low).to_pylist()
            low = high


def ranges(cut: DataFrame, state) -> tuple[dict[tuple[str, int], tuple[int, int, int, int]], dict[str, int]]:
    """(file, block) -> (number of the range, number of its file, state at its start, records that end before it in the file), and
    each file's last state.  One row a range comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[tuple[str, int], list] = {}
        for key, values in _by_range(batches):
            for scan in ends.setdefault(key, [[s, Counter()] for s in state.starts]):
                now, levels = scan
                for piece in values:
                    now, level = state.step(now, piece)
                    if level is not None:
                        levels[level] += 1
                scan[0] = now
        rows = [(*key, json.dumps(scans)) for key, scans in ends.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "block", "ends"])

    found, last = {}, {}
    for file, block, ends in sorted(map(tuple, cut.mapInArrow(run, "file string, block bigint, ends string").collect())):
        if file not in last:
            now, before = state.first, 0
        found[file, block] = (len(found), len(last) - (file in last), now, before)
        end, levels = json.loads(ends)[state.kind(now)]
        before += levels.get(str(state.level - state.shift(now)), 0)
        last[file] = now = state.after(now, end)
    return found, last


def records(cut: DataFrame, state, found: dict) -> DataFrame:
    """(place, file, number, record): each record's bytes up to and with its last separator; numbers count within a file.

    ``place`` rises in the order of the source; its upper bits are the number of the range in which the record begins.
    What stands behind a file's last separator is a record if ``state`` ends one there, else the beginning of one.
    """
    shared, separator = cut.sparkSession.sparkContext.broadcast(found), state.separator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        key, held = None, []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["place", "file", "number", "part", "record"])
            rows.clear()
            return batch

        for block, values in _by_range(batches):
            if block != key:
                if held:
                    rows.append((place, file, number, part | BEGINNING, b"".join(held)))
                if block not in shared.value:
                    raise SourceError("the ranges of the source changed while it was read; read it again")
                key, held = block, []
                index, file, now, number = shared.value[block]
                place, part = index << PLACE_BITS, WHOLE if now in (state.first, state.between) else END
            for piece in values:
                now, level = state.step(now, piece)
                held += (piece, separator)
                if level == state.level:
                    rows.append((place, file, number, part, b"".join(held)))
                    place, number, part, held = place + 1, number + 1, WHOLE, []
                    if len(rows) == BATCH:
                        yield out()
        if held:
            rows.append((place, file, number, part | BEGINNING, b"".join(held)))
        yield out()

    made = cut.mapInArrow(run, "place bigint, file int, number bigint, part int, record binary")
    names = ["place", "file", "number", "record"]
    parts = made.where(F.col("part") != WHOLE).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("place", "record"))).alias("p"))
    joined = parts.select(F.col("p")[0]["place"].alias("place"), "file", "number", F.aggregate("p", F.expr("X''"), lambda a, x: F.concat(a, x["record"])).alias("record"))
    return made.where(F.col("part") == WHOLE).select(*names).union(joined.select(*names))
