"""Helpers shared by the operators: checkpoints in the shared folder, words, bounded caches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import scratch_path, shared_dir, table  # noqa: F401  (the operators take them from here)

#: A-Z to a-z on UTF-8 bytes; other letters stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The separators of words: U+0020 and U+0009 to U+000D, as bytes.split() has them.
SPACES = b" \t\n\v\f\r"


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Hints a broadcast only if the counted rows are within a bound; else Spark joins by shuffling."""
    return F.broadcast(df) if rows <= max_rows else df


def utf8(column: str):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, alike within a process only."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


#: Odd multipliers of the rolling window hash.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` words; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out *= _STEP
        out += hashes[i : i + n]
        out ^= out >> np.uint64(29)
        out *= _MIX
    return out


class Cache(dict):
    """A dict that fills itself by ``make``.  Beyond ``limit`` bytes of keys and values, of which each has a length and takes
    OVERHEAD more, it starts anew but keeps the last generation at hand, so that its memory is bounded and what is in use is
    not made again.  What is longer than LONGEST is made anew each time."""

    OVERHEAD, LONGEST = 200, 1 << 12

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old, self.held = make, limit, {}, 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        size = len(key) + (len(value) if isinstance(value, (bytes, str)) else 8)
        if size > self.LONGEST:
            return value
        if self.held >= self.limit // 2:
            self.old, self.held = dict(self), 0
            self.clear()
        self.held += size + self.OVERHEAD
        self[key] = value
        return value
