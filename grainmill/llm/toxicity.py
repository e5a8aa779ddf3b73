"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, scaled by length, with exception phrases."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Letters that look like Latin ones, and digits and marks that stand for letters inside words.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ӏ": "l", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Words of abuse with the weight that they have where no labels tell.
SEED = {"idiot": 2.0, "moron": 2.0, "stupid": 1.5, "loser": 1.5, "pathetic": 1.5, "worthless": 1.5, "scum": 2.0, "disgusting": 1.5, "trash": 1.0, "clown": 1.0, "imbecile": 2.0, "bastard": 2.0, "asshole": 2.5, "bitch": 2.0}
#: Phrases in which a word of the lexicon is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "circus clown", "rodeo clown", "pond scum", "soap scum", "idiot proof", "sore loser board game", "the idiot by dostoevsky")
#: Labelled rows that the lexicon and its calibration are learned from, at most.
MAX_LABELLED = 20_000
#: A learned word stands in so many toxic rows, after so many different words, and is so much likelier there (log odds).
#: A learned stem, written with a star, begins so many different words instead; it counts in texts where it begins two or
#: more different words.
MIN_ROWS, MIN_BEFORE, MIN_WEIGHT, MAX_WEIGHT = 3, 3, 2.0, 5.0
#: Least likelihood-ratio statistic (G squared) of a learned entry; among hundreds of thousands of words few reach it by chance.
MIN_EVIDENCE = 24.0
STEMS = (4, 5, 6, 7, 8)
THRESHOLD = 0.3

#: One-to-one foldings; marks become letters only inside a word, see fold().
_GLYPHS = str.maketrans(HOMOGLYPHS)
_MIXED = re.compile(r"(?<![\w@$])(?=[\w@$]*[^\W\d_])[\w@$]*[0-9@$][\w@$]*")
_SUBSTITUTES = str.maketrans(SUBSTITUTES)
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "]")
_MARK = re.compile("[0-9@$]")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case, homoglyphs as Latin letters, digits and marks inside words as the letters that they stand for."""
    text = text.lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_GLYPHS)
    if _MARK.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_SUBSTITUTES), text)
    return text


def entries(text: str) -> dict[str, str]:
    """What a folded text offers to the lexicon: its words, each with the word before its first place, and each stem that begins two or more of its words, with the first of them."""
    last, found, begun, stems = "", {}, {}, {}
    for w in _WORD.findall(text):
        if w not in found:
            found[w] = last
            for k in STEMS:
                if len(w) > k:
                    stem = w[:k] + "*"
                    if begun.setdefault(stem, w) != w:
                        stems[stem] = begun[stem]
        last = w
    return found | stems


class Lexicon:
    """Weighted words and stems and exception phrases in one automaton."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        found: dict[str, list[tuple[int, bool, float | None]]] = {}
        for phrase in exceptions:
            found.setdefault(phrase, []).append((len(phrase), True, None))
        for word, weight in weights.items():
            stem = word.rstrip("*")
            found.setdefault(stem, []).append((len(stem), stem == word, float(weight)))
        for text, said in found.items():
            self.automaton.add_word(text, said)
        self.empty = not found
        self.automaton.make_automaton()

    def features(self, text: str) -> tuple[float, float, int]:
        """The weight of all matches, the same for each hundred words, and the number of matches; a word counts once, by its best entry."""
        folded = fold(text)
        found: dict[int, list[tuple[float, int, str]]] = {}
        begun: dict[str, set[str]] = {}
        spared: list[tuple[int, int]] = []
        for end, said in () if self.empty else self.automaton.iter(folded):
            ends_word = end + 1 >= len(folded) or not folded[end + 1].isalnum()
            for size, whole, weight in said:
                start = end - size + 1
                if (start and folded[start - 1].isalnum()) or whole != ends_word:
                    continue
                if weight is None:
                    spared.append((start, end))
                    continue
                stem = "" if whole else folded[start : end + 1]
                if stem:
                    begun.setdefault(stem, set()).add(_WORD.match(folded, start)[0])
                found.setdefault(start, []).append((weight, end, stem))
        kept = []
        for start, own in found.items():
            live = [(w, end) for w, end, stem in own if not stem or len(begun[stem]) > 1]
            if live and not any(a <= start and max(live)[1] <= b for a, b in spared):
                kept.append(max(live)[0])
        words = max(1, folded.count(" ") + folded.count("\n") + 1)
        return sum(kept), 100 * sum(kept) / words, len(kept)


def model_input(total: float, density: float) -> tuple[float, float, float]:
    return 1.0, np.log1p(total), np.log1p(density)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton steps on the ridge-penalised log likelihood."""
    w = np.zeros(x.shape[1])
    penalty = ridge * len(y) / 100 * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """A lexicon and the logistic curve over its two figures."""

    def __init__(self, weights: dict[str, float], curve: tuple[float, ...], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.weights, self.curve, self.exceptions = weights, curve, exceptions
        self._lexicon: Lexicon | None = None

    def __getstate__(self):
        return self.weights, self.curve, self.exceptions

    def __setstate__(self, state):
        self.weights, self.curve, self.exceptions = state
        self._lexicon = None

    @property
    def lexicon(self) -> Lexicon:
        if self._lexicon is None:
            self._lexicon = Lexicon(self.weights, self.exceptions)
        return self._lexicon

    def score(self, text: str) -> float:
        total, density, _ = self.lexicon.features(text)
        return float(1 / (1 + np.exp(-np.clip(np.dot(self.curve, model_input(total, density)), -30, 30))))


#: The curve where there are no labels: about two words of abuse in a text of a hundred words reach the threshold.
DEFAULT_CURVE = (-4.0, 2.0, 0.6)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> Model:
    """The model from at most ``max_labelled`` labelled rows, those whose ids have the least hashes.

    Rows with a null id or label, and ids that occur with both labels, teach nothing; of several texts of an id the one of
    least hash teaches.  Without labels of both kinds the
    seed words and the default curve stand.
    """
    ids = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    ids = ids.where("label = other and label in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", "label")
    chosen = F.broadcast(table(ids, "toxicity-labels"))  # max_labelled rows of two numbers
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # One text for each id, so that repeated ids don't stretch the bound; the minimum is taken within tasks first.
    one = text.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = table(one.select("label", "text"), "toxicity-sample")
    if len({r["label"] for r in sample.select("label").distinct().collect()}) < 2:
        return Model(dict(SEED), DEFAULT_CURVE)
    # The curve is fitted to figures that each half of the sample gets from the other half's lexicon, as new texts would.
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    rows = []
    for k in (0, 1):
        draft = Model(_weights(sample.where(half != k)), DEFAULT_CURVE)
        rows += sample.where(half == k).mapInArrow(_figures(draft), "label int, total double, density double").collect()  # max_labelled rows of three numbers in all
    rows = sorted(rows)  # the fit does not hang on the order in which tasks end
    x, y = np.array([model_input(r["total"], r["density"]) for r in rows]), np.array([r["label"] for r in rows], float)
    curve = fit_logistic(x, y)
    if (curve[1:] < 0).any():  # a text with more abuse must not score lower: one figure is enough then
        curve = np.append(fit_logistic(x[:, :2], y), 0.0)
    return Model(_weights(sample), tuple(curve.tolist()))


def _figures(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.lexicon.features(x.as_py())[:2] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *(pa.array([f[i] for f in found], pa.float64()) for i in (0, 1))], names=["label", "total", "density"])

    return run


def _toxic_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, before), once for each entry of each row."""
    for batch in batches:
        found = [entries(fold(x.as_py())) for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([pa.array([k for f in found for k in f], pa.string()), pa.array([v for f in found for v in f.values()], pa.string())], names=["entry", "before"])


def _clean_rows(wanted: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[str, int] = {}
        for batch in batches:
            for text in batch.column("text"):
                for w in wanted.intersection(entries(fold(text.as_py()))):
                    tally[w] = tally.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())], names=["entry", "n"])

    return run


def _weights(sample: DataFrame) -> dict[str, float]:
    """The lexicon from (label, text): seed words that no row has, and words and stems by their log odds where these are well founded."""
    sums = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    pairs = sample.where("label = 1").select("text").mapInArrow(_toxic_entries, "entry string, before string").groupBy("entry", "before").agg(F.count("*").alias("n"))
    likely = pairs.groupBy("entry").agg(F.sum("n").alias("n"), F.count("*").alias("n_before")).where((F.col("n") >= MIN_ROWS) & (F.col("n_before") >= MIN_BEFORE))
    # As many entries as MIN_ROWS rows of the bounded sample share, at most.
    toxic = {r["entry"]: r["n"] for r in likely.select("entry", "n").collect()}
    wanted = frozenset(toxic) | frozenset(SEED)
    clean = {r["entry"]: r["n"] for r in sample.where("label = 0").select("text").mapInArrow(_clean_rows(wanted), "entry string, n bigint").groupBy("entry").agg(F.sum("n").alias("n")).collect()}
    n_toxic, n_clean = sums.get(1, 0), sums.get(0, 0)
    found = {w: x for w, n in toxic.items() if (x := log_odds(n, clean.get(w, 0), n_toxic, n_clean)) >= MIN_WEIGHT and evidence(n, clean.get(w, 0), n_toxic, n_clean) >= MIN_EVIDENCE}
    # Words and longer stems that begin with a learned stem say nothing of their own.
    learned = {w: round(min(x, MAX_WEIGHT), 6) for w, x in found.items() if not any(w[:k] + "*" in found for k in STEMS if k < len(w.rstrip("*")))}
    return {w: s for w, s in SEED.items() if w not in toxic and not clean.get(w, 0)} | learned


def log_odds(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Of an entry in so many of the toxic and of the clean rows."""
    return float(np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1)))


def evidence(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """Likelihood-ratio statistic of the entry's rows against the share of toxic rows in all."""
    share = n_toxic / (n_toxic + n_clean)
    part = lambda n, p: n * np.log(n / ((toxic + clean) * p)) if n else 0.0
    return float(2 * (part(toxic, share) + part(clean, 1 - share)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted), one row for each row of ``docs``.

    A null or empty text scores as a text without matches.  Whole texts are matched where they are read; repeated rows
    score alike; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(x.as_py()) for x in batch.column("text")], pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, score double").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
