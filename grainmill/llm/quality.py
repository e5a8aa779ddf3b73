"""Quality rules by distribution divergence: character classes and common words against language references."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, utf8, window_hashes, word_hashes

#: Common words of the languages whose references have words too; others have character classes alone.
COMMON_WORDS = {
    "en": "the of and to in is that it for on with as was be by at this are or from an not have you he his they which but we",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ses ou",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si",
}
LANGUAGES = tuple(COMMON_WORDS)
SYMBOLS = b"#*$%&|<>"
#: Character classes of UTF-8 bytes: lower case, upper case, lead bytes of other letters, digits, sentence marks, other
#: marks, symbols, blanks and controls; bytes that continue a character are not counted.
N_CLASSES = 8
_CLASS = np.full(256, 2, np.uint8)
_CLASS[0x80:0xC0] = N_CLASSES
_CLASS[:0x21] = 7
_CLASS[0x7F] = 7
_CLASS[0x21:0x7F] = 5
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[list(b".,;:?!'\"")] = 4
_CLASS[list(SYMBOLS)] = 6
_VOCABULARY = {lang: {w.encode(): i for i, w in enumerate(words.split())} for lang, words in COMMON_WORDS.items()}
_N_WORDS = max(map(len, _VOCABULARY.values())) + 1
N_FEATURES = N_CLASSES + len(LANGUAGES) * _N_WORDS

#: Guards and limits.  Distances are Jensen-Shannon distances to the base 2, from 0 to 1.  Few characters stray further
#: from any reference by chance, so the limit for classes falls with the root of a text's length in bytes.
MIN_CHARS, MIN_WORDS = 200, 100
MAX_CLASS_DISTANCE, MAX_CLASS_CHANCE = 0.12, 2.4
MAX_WORD_DISTANCE = 0.275
#: Texts with more capitals or symbols than these shares of their characters are no part of a reference.
MAX_REFERENCE_UPPER, MAX_REFERENCE_SYMBOLS = 0.25, 0.01
#: Least documents for the reference of a language without common words.
MIN_REFERENCE_DOCS = 20
MIN_BASE_WORDS, MAX_REPEAT_PERCENT, REPEAT_WIDTH = 20, 30, 8


def _counts(data: bytes, words: list[bytes]) -> np.ndarray:
    """Class counts, then for each language the counts of its common words and of all others."""
    out = np.zeros(N_FEATURES)
    out[:N_CLASSES] = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=N_CLASSES + 1)[:N_CLASSES]
    plain = [w.strip(b".,;:?!'\"()").lower() for w in words]
    for k, lang in enumerate(LANGUAGES):
        at, known = N_CLASSES + k * _N_WORDS, _VOCABULARY[lang]
        own = np.bincount([known[w] for w in plain if w in known], minlength=_N_WORDS)
        out[at : at + _N_WORDS] = own
        out[at + _N_WORDS - 1] = len(words) - own.sum()
    return out


def _blocks() -> list[slice]:
    return [slice(0, N_CLASSES), *(slice(N_CLASSES + k * _N_WORDS, N_CLASSES + (k + 1) * _N_WORDS) for k in range(len(LANGUAGES)))]


def _shares(counts: np.ndarray) -> np.ndarray:
    out = counts.astype(float)
    for b in _blocks():
        out[b] /= max(out[b].sum(), 1)
    return out


def is_plain(share: np.ndarray) -> bool:
    return share[1] <= MAX_REFERENCE_UPPER and share[6] <= MAX_REFERENCE_SYMBOLS


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> float:
    """Distance of two distributions, 0 (alike) to 1 (no common support)."""
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """A reference for each language: the mean share of each feature over all its documents long enough to tell and not full of symbols.

    The sums are made by Spark over every row; the driver gets one row for each feature of a language with common words
    and for each character class of any other language of ``MIN_REFERENCE_DOCS`` documents or more.  A language without
    documents has no reference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                data, least = text.as_py(), MIN_WORDS if lang in COMMON_WORDS else MIN_BASE_WORDS
                if len(data) >= MIN_CHARS and len(words := data.split()) >= least and is_plain(share := _shares(_counts(data, words))):
                    own = sums.setdefault(lang, np.zeros(N_FEATURES if lang in COMMON_WORDS else N_CLASSES))
                    own += np.round(share[: len(own)] * 2**20)  # whole numbers: any order of summing gives the same
                    n[lang] = n.get(lang, 0) + 1
        for lang, own in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(own)), pa.array(range(len(own)), pa.int32()), pa.array(own.astype(np.int64)), pa.array([n[lang]] * len(own))], names=["lang", "feature", "total", "docs"]
            )

    known = docs.where(F.col(lang_col).isNotNull()).select(utf8(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = known.mapInArrow(run, "lang string, feature int, total bigint, docs bigint").groupBy("lang", "feature").agg(F.sum("total").alias("total"), F.sum("docs").alias("docs"))
    rows = sums.where(F.col("lang").isin(*LANGUAGES) | (F.col("docs") >= MIN_REFERENCE_DOCS)).collect()
    out = {lang: np.zeros(N_FEATURES if lang in COMMON_WORDS else N_CLASSES) for lang in {r.lang for r in rows}}
    for r in rows:
        out[r.lang][r.feature] = r.total / r.docs / 2**20
    return {lang: _shares(out[lang]) for lang in (*LANGUAGES, *sorted(out.keys() - COMMON_WORDS.keys())) if lang in out}


def base_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    n = len(words)
    shown = data.translate(None, SPACES)
    chars = len(shown) - int(np.count_nonzero((np.frombuffer(shown, np.uint8) & 0xC0) == 0x80))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line.strip(SPACES):
            dup += line in seen
            seen.add(line)
    windows = window_hashes(word_hashes(words), REPEAT_WIDTH)
    repeat = 0
    if len(windows) > 1:
        _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(times[at] > 1)
        if len(hit):  # equal hashes only propose: the words decide
            said = [b" ".join(words[i : i + REPEAT_WIDTH]) for i in hit.tolist()]
            exact = Counter(said)
            hit = hit[np.fromiter((exact[x] > 1 for x in said), bool, len(said))]
        if len(hit):
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + REPEAT_WIDTH, -1)
            repeat = int(np.count_nonzero(np.cumsum(edge)[:n]))
    return n, chars, symbols, dup, repeat


def judge(data: bytes, refs: dict[str, np.ndarray], lang: str | None) -> tuple:
    """The base counts, base_failed, kept, and the two least distances (null below their guard's length).

    Distances are to the languages with common words and to the text's own; they are null if its own has no reference,
    and for words if it has no common words.
    """
    words = data.split()
    counts = base_counts(data, words)
    failed = counts[0] < MIN_BASE_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    by_class = by_word = None
    size = len(data)
    if lang in refs and size >= MIN_CHARS:
        own = _counts(data, words)
        share = _shares(own)
        by_class = min(jensen_shannon(share[:N_CLASSES], refs[x][:N_CLASSES]) for x in {*LANGUAGES, lang} if x in refs)
        if lang not in COMMON_WORDS:
            size = max(own[:N_CLASSES].sum(), 1)  # other scripts have several bytes for a character
        elif len(words) >= MIN_WORDS:
            by_word = min(jensen_shannon(share[b], refs[x][b]) for x, b in zip(LANGUAGES, _blocks()[1:]) if x in refs)
    kept = not failed and (by_class is None or by_class <= MAX_CLASS_DISTANCE + MAX_CLASS_CHANCE / size**0.5) and (by_word is None or by_word <= MAX_WORD_DISTANCE)
    return *counts, failed, kept, by_class, by_word


COLUMNS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, class_distance double, word_distance double"
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
_TYPES = [{"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[c.split()[1]] for c in COLUMNS.split(", ")]


def quality(docs: DataFrame, refs: dict[str, np.ndarray] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id and COLUMNS, one row for each row of ``docs``.

    Without ``refs`` the references are first taken from all of ``docs``.  A null text has no words and fails the base
    rules.  A text below the guards' lengths, or whose language is null or has no reference, is judged by the base rules alone.
    Repeated rows are judged each for itself; an empty table gives no rows.
    """
    if refs is None:
        refs = references(docs, text_col, lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(x.as_py(), refs, lang) for x, lang in zip(batch.column("text"), batch.column("lang").to_pylist())]
            columns = list(zip(*found)) if found else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, _TYPES))], names=["doc_id", *_NAMES])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, f"doc_id bigint, {COLUMNS}")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; the text is judged where it is, so nothing is shuffled.

    A null or empty text fails the base rules and goes; a null language, or one without a reference, is judged by the base
    rules; repeated rows stay or go together; an empty table gives no rows.
    """
    refs = references(docs, text_col, lang_col)

    @F.pandas_udf("boolean")
    def good(texts, langs):
        return pd.Series([judge(x or b"", refs, lang)[6] for x, lang in zip(texts, langs)], dtype=bool)

    return docs.where(good(utf8(text_col), F.col(lang_col).cast("string")))


