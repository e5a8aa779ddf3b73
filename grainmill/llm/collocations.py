"""Phrases whose words stand together more often than apart, mined by growing prefixes to the right.

Words are counted first.  Then each occurrence of a frequent word is projected: a pointer to it carries the words that
follow in its piece.  All pointers of one prefix go to one task, which extends the prefix by each word that follows often
enough, and that prefix again, depth-first.  Pointers alike are counted together before they are shuffled.  The pointers of
a hot prefix are dealt by the next word too, and by one more if that is hot as well; the counts of prefixes dealt in this way
are added up at the end.

Words travel as 64-bit hashes of language and word, by a seed under which no two words share the hash of a frequent one;
that is checked over all words of the corpus.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, Cache, small, table, utf8

LONGEST, LEAST, TOP, COVERED = 3, 10, 2000, 50
NO_LANG = "und"
#: The bytes that end a piece: .,;:!? and U+000A to U+000D.
ENDS = b".,;:!?\n\v\f\r"
_MARK = b"."
_PREPARE = bytes(LOWER[c] if c not in ENDS else _MARK[0] for c in range(256))
_END = re.compile(b"[" + re.escape(ENDS) + b"]")
#: Bytes of text that are cut at a time, distinct words that a task counts before it sends them on, pointers that it sorts at a time.
BLOCK, HELD_WORDS, HELD_POINTERS = 2 << 20, 1 << 18, 1 << 19
#: Bytes of words and hashes that a worker remembers, and of how many languages at a time.
MEMORY, MOST_LANGS = 48 << 20, 64
#: Pointers that one step of a task takes; hot words fill more than two such steps, and are at most HOTTEST, as each is at least that share of all words.
BUCKET, HOTTEST = 1 << 18, 1_000_000
#: Bits of the map of frequent words, which is broadcast: 4 MB whatever the corpus.
MAP_BITS = 1 << 25
_PIECE_BITS = 32_768
#: Marks the end of a piece among the hashes of words.
NONE = np.uint64(0)


def blocks(data: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text in blocks that end where a piece ends."""
    start = 0
    while len(data) - start > size:
        found = _END.search(data, start + size)
        if not found:
            break
        yield data[start : found.end()]
        start = found.end()
    yield data[start:]


def words(data: bytes) -> list[bytes]:
    """Words in lower case, with ``.`` wherever a piece ends; no word holds one."""
    return data.translate(_PREPARE).replace(_MARK, b" . ").split()


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, text) blocks of a batch: short texts of one language together, with a piece's end between them."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: Counter = Counter()
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
        for block in blocks(text.as_py()):
            held[lang].append(block)
            sizes[lang] += len(block)
            if sizes[lang] > BLOCK:
                yield lang, b" . ".join(held.pop(lang))
                del sizes[lang]
    for lang, some in held.items():
        yield lang, b" . ".join(some)


def _hash(lang: str, seed: int):
    """Hashes of a language's words."""
    state = lang.encode() + b"\0"
    return lambda word: (xxhash.xxh64_intdigest(state + word, seed) or 1) if word != _MARK else 0


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), utf8(text_col).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of (lang, text); words are binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)

        def out() -> pa.RecordBatch:
            rows = [(lang, word, n) for lang, c in counts.items() for word, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, data in _by_lang(batch):
                counts[lang].update(words(data))
                counts[lang].pop(_MARK, None)
                if sum(map(len, counts.values())) > HELD_WORDS:
                    yield out()
        yield out()

    return texts.mapInArrow(run, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashed(counts: DataFrame, seed: int) -> DataFrame:
    """``counts`` with the column h: the hash of language and word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hash(lang, seed)(word.as_py()) for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(found, np.uint64).view(np.int64))], names=[*batch.schema.names, "h"])

    return counts.mapInArrow(run, "lang string, word binary, n bigint, h bigint")


def _bits(frequent: DataFrame) -> np.ndarray:
    """A map of MAP_BITS bits with those of the frequent words' hashes set; it comes in pieces of 4 KB, of which there are at most MAP_BITS / 32,768."""
    slot = F.shiftrightunsigned("h", 64 - (MAP_BITS.bit_length() - 1))
    pieces = frequent.groupBy(F.bitmap_bucket_number(slot).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    out = np.zeros(MAP_BITS // 8, np.uint8)
    for at, bits in pieces:
        # Slot 0 has bucket 0 of its own; bucket k > 0 has the slots 1 + (k - 1) x 32,768 to k x 32,768, the first as bit 0.
        if at > 0:
            out[(at - 1) * _PIECE_BITS // 8 : at * _PIECE_BITS // 8] = np.frombuffer(bits, np.uint8)
    return out


def _may_be_frequent(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h >> np.uint64(64 - (MAP_BITS.bit_length() - 1))).astype(np.int64)
    return ((bits[(slot - 1) >> 3] >> ((slot - 1) & 7).astype(np.uint8)) & 1).astype(bool) | (slot == 0)


def _among(hot: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is one of the sorted array ``hot``."""
    at = np.searchsorted(hot, h)
    return (hot[np.minimum(at, len(hot) - 1)] == h) if len(hot) else np.zeros(len(h), bool)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def pointers(texts: DataFrame, seed: int, frequent_bits, hot_words, n_buckets: int, longest: int) -> DataFrame:
    """(bucket, pointers): the occurrences of frequent words with the words that follow, dealt by prefix, those alike counted together.

    ``frequent_bits`` and ``hot_words`` are broadcast variables.  A pointer is a row of ``longest`` hashes, NONE where the
    piece ends or a word is too rare for any phrase.
    """

    def packed(columns: list[np.ndarray]) -> Iterator[tuple[int, bytes, int]]:
        hot = hot_words.value
        owner, split = _mixed(columns[0]), np.ones(len(columns[0]), bool)
        for i in range(longest - 1):
            split &= _among(hot, columns[i])
            owner = np.where(split, _mixed(owner + columns[i + 1]), owner)
        bucket = owner % np.uint64(n_buckets)
        # One sort brings pointers alike together, bucket by bucket: leading bits of the bucket, then of each word.
        width = max(1, (n_buckets - 1).bit_length())
        each, key, left = (64 - width) // longest, bucket << np.uint64(64 - width), 64 - width
        for c in columns:
            left -= each
            key |= (c >> np.uint64(64 - each)) << np.uint64(left)
        order = np.argsort(key, kind="stable")
        columns, bucket = [c[order] for c in columns], bucket[order]
        new = np.ones(len(bucket), bool)
        new[1:] = bucket[1:] != bucket[:-1]
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(new))).astype(np.uint32)
        columns, bucket = [c[at] for c in columns], bucket[at]
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            yield int(bucket[a]), pa.compress(b"".join([*(c[a:b].tobytes() for c in columns), times[a:b].tobytes()]), "zstd", asbytes=True), int(b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = frequent_bits.value, {}
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            rows = list(packed([np.concatenate(c) for c in zip(*held)]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["bucket", "pointers", "n"])

        for batch in batches:
            for lang, data in _by_lang(batch):
                if lang not in known:
                    if len(known) == MOST_LANGS:
                        known.clear()
                    known[lang] = Cache(_hash(lang, seed), MEMORY)
                    for cache in known.values():
                        cache.limit = MEMORY // len(known)
                found = words(data)
                h = np.fromiter(map(known[lang].__getitem__, found), np.uint64, len(found))
                h[~_may_be_frequent(bits, h)] = NONE
                h = np.append(h, np.zeros(longest, np.uint64))
                columns = [h[i : len(h) - longest + i] for i in range(longest)]
                keep = (columns[0] != NONE) & (columns[1] != NONE)
                columns = [c[keep] for c in columns]
                for i in range(2, longest):
                    columns[i] = np.where(columns[i - 1] == NONE, NONE, columns[i])
                held.append(columns)
                size += len(columns[0])
                if size > HELD_POINTERS:
                    yield out()
                    size = 0
        if size:
            yield out()

    return texts.mapInArrow(run, "bucket bigint, pointers binary, n bigint")


def grown(dealt: DataFrame, hot_words, least: int, longest: int) -> DataFrame:
    """(h1, ..., a): the prefixes of two words or more that grow from each bucket's pointers, with their occurrences there.

    A prefix that lies in one bucket alone is left out below ``least``; one that was dealt to several is given in parts.
    """
    names = [f"h{i}" for i in range(1, longest + 1)]

    def run(group: pa.Table) -> pa.Table:
        parts = []
        for blob, n in zip(group.column("pointers"), group.column("n").to_pylist()):
            data = pa.decompress(blob.as_py(), n * (8 * longest + 4), "zstd", asbytes=True)
            parts.append([*np.frombuffer(data, np.uint64, n * longest).reshape(longest, n), np.frombuffer(data, np.uint32, n, 8 * longest * n).astype(np.int64)])
        *columns, times = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort(columns[::-1])
        columns, upto = [c[order] for c in columns], np.append(0, np.cumsum(times[order]))
        hot = [_among(hot_words.value, c) for c in columns]
        found: list[tuple] = []

        def grow(low: int, high: int, depth: int, prefix: tuple, split: bool) -> None:
            """The pointers from ``low`` to ``high`` share ``prefix``; each word that follows it makes a longer one."""
            column = columns[depth][low:high]
            cuts = [low, *(np.flatnonzero(column[1:] != column[:-1]) + 1 + low).tolist(), high]
            for a, b in zip(cuts, cuts[1:]):
                n, more = int(upto[b] - upto[a]), depth + 1 < longest
                # A prefix lies in several buckets only where all its words are hot and another may follow.
                several = split and more and bool(hot[depth][a])
                if columns[depth][a] == NONE or n < least and not several:
                    continue
                longer = (*prefix, int(columns[depth][a]))
                if depth:
                    found.append((*longer, *[0] * (longest - depth - 1), n))
                if more:
                    grow(a, b, depth + 1, longer, several)

        grow(0, len(order), 0, (), True)
        columns_out = [pa.array(np.array([f[i] for f in found], np.uint64).view(np.int64)) for i in range(longest)]
        return pa.Table.from_arrays([*columns_out, pa.array([f[-1] for f in found], pa.int64())], names=[*names, "a"])

    return dealt.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "a"]))


#: Languages whose word totals may be broadcast; parts in which the best phrases of a language are found before they meet.
MAX_BROADCAST_LANGS, RANKED_APART = 100_000, 64


def frequencies(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (h1, ..., a) of two to ``longest`` words that occur ``least`` times or more, such words (lang, word, n, h), and (lang, n) of all words."""
    spark, texts = docs.sparkSession, _texts(docs, text_col, lang_col)
    counts = table(word_counts(texts), "phrase-words")
    for seed in range(100):
        coded = table(hashed(counts, seed), "phrase-coded")
        shared = coded.groupBy("h").agg(F.count("*").alias("of"), F.sum("n").alias("n")).where((F.col("of") > 1) & (F.col("n") >= least))
        if shared.isEmpty():
            break
    else:
        raise RuntimeError("no seed keeps the hashes of all words apart")
    frequent, totals = coded.where(F.col("n") >= least), coded.groupBy("lang").agg(F.sum("n").alias("n"))
    total = coded.agg(F.sum("n")).first()[0] or 0
    hot = coded.where(F.col("n") >= max(2 * BUCKET, total // HOTTEST)).select("h").toArrow().column("h").to_numpy().view(np.uint64)
    bits, hot = spark.sparkContext.broadcast(_bits(frequent)), spark.sparkContext.broadcast(np.sort(hot))
    parts = grown(pointers(texts, seed, bits, hot, -(-total // BUCKET) or 1, longest), hot, least, longest)
    names = [c for c in parts.columns if c != "a"]
    phrases = parts.groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return table(phrases, "phrases"), frequent, totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by score, then count, then bytes.

    A phrase has 2 to ``longest`` words of one piece and a >= ``least`` occurrences, overlaps included.  Each cut into a
    first part with l and a rest with r occurrences scores floor(10^6 a a / (l r)), in whole numbers; the cut with the
    lowest score counts, the earliest of those alike.  A phrase that lies within a longer one with at least ``covered``
    hundredths of its occurrences goes.  n counts all words of the language.  A null language is ``und``, a null text is
    empty; repeated rows count each for itself; an empty table gives no rows.
    """
    phrases, frequent, totals = frequencies(docs, text_col, lang_col, longest, least)
    names = [f"h{i}" for i in range(1, longest + 1)]
    key = lambda first, end: [F.col(names[i]) if i < end else F.lit(0).cast("bigint") for i in range(first, first + longest)]
    named = lambda columns, mark: F.struct(*(c.alias(f"{mark}{i}") for i, c in enumerate(columns)))
    known = phrases.union(frequent.select("h", *(F.lit(0).cast("bigint") for _ in names[1:]), "n"))

    cuts = F.filter(F.array(*(F.when(F.col(names[k]) != 0, F.struct(F.lit(k).alias("k"), named(key(0, k), "p").alias("p"), named(key(k, longest), "q").alias("q"))) for k in range(1, longest))), lambda c: c.isNotNull())
    rows = phrases.select(*names, "a", F.explode(cuts).alias("cut")).select(*names, "a", "cut.k", "cut.p.*", "cut.q.*")
    of = lambda mark, count: known.toDF(*(f"{mark}{i}" for i in range(longest)), count)
    rows = rows.join(of("p", "l"), [f"p{i}" for i in range(longest)]).join(of("q", "r"), [f"q{i}" for i in range(longest)])
    whole = lambda c: F.col(c).cast("decimal(15,0)")
    rows = rows.withColumns({"up": F.lit(1_000_000).cast("decimal(7,0)") * whole("a") * whole("a"), "down": whole("l") * whole("r")}).withColumn("score", F.expr("up div down"))
    best = rows.groupBy(*names, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    inner = [(first, end) for size in range(2, longest) for first in range(longest - size + 1) for end in [first + size]]
    longer = lambda first, end: F.col(names[end]) != 0 if first == 0 else F.col(names[end - 1]) != 0
    if inner:
        within = F.filter(F.array(*(F.when(longer(*x), named(key(*x), "w")) for x in inner)), lambda c: c.isNotNull())
        over = phrases.select(F.explode(within).alias("w"), "a").groupBy("w").agg(F.max("a").alias("over"))
        over = over.select(*(F.col(f"w.w{i}").alias(n) for i, n in enumerate(names)), "over")
        best = best.join(over, names, "left").where(F.col("over").isNull() | (100 * F.col("over") < covered * F.col("a")))

    for i, n in enumerate(names):
        word = frequent.select(F.col("h").alias(n), F.col("word").cast("string").alias(f"word{i}"), *([F.col("lang")] if i == 0 else []))
        best = best.join(word, n, "inner" if i < 2 else "left")
    phrase = F.concat_ws(" ", *(f"word{i}" for i in range(longest)))
    found = best.select("lang", phrase.alias("phrase"), "a", "best.l", "best.r", "best.score", F.pmod(F.xxhash64(*names), F.lit(RANKED_APART)).alias("part"))
    order = (F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    apart = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = apart.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return ranked.join(small(totals, totals.count(), MAX_BROADCAST_LANGS), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
