"""Byte-level BPE by dynamic programming over prefixes, and decoding.

The tokens of a prefix of a byte string are fixed but for its last one, which is fixed too: it is the only token t that ends
there, was made by merges of its own bytes, and fits the last token of what stands before t, that is, no merge reaches over
the place between the two before both are whole.  So a table of one token for each prefix holds the encodings of all
prefixes.  Bytes are appended by filling in their own entries; after a change the entries are filled in from there until as
many of them as the longest token has bytes are as they were, as an entry depends on no others.

A text is cut by a pattern, and each match is encoded for itself; a match that is a token is that token.  Matches repeat, so
a worker remembers many of them.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from os.path import commonprefix
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8
from .tokens import worker

#: Bytes of matches and their ids that a worker remembers, and what an entry takes besides; pairs of tokens that it remembers.
MEMORY, ENTRY, PAIRS = 64 << 20, 200, 1 << 18
#: Matches that are encoded together; rows that a task hands on at a time.
TOGETHER, ROWS = 1 << 18, 1_000
#: Characters that are cut at a time.
WINDOW = 1 << 16
#: How far beyond its end a match of the public pattern may look: a contraction's letters, or a blank and what follows it.
REACH = 3
_NEVER = 1 << 62
#: Stands for the last token of the empty prefix.
START = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file and their ranks: each line has a token as base64 and its rank, which is its id as well."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Vocabulary:
    """The tokens of a rank file; those of lower ranks merge first."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.ends.make_automaton()
        self.fits, self.halves, self.edge = (lru_cache(PAIRS)(f) for f in (self._fits, self._halves, self._edge))

    def merge(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Plain BPE: the pair of the lowest rank merges, the leftmost first, until ``down_to`` parts are left or none merges."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge that makes a token; None if merges do not make it."""
        parts = self.merge(token, 2)
        if len(parts) != 2:
            return None
        if max(self.ranks[p] for p in parts) > self.ranks[token]:
            raise ValueError(f"the rank of {token!r} is below that of its parts")
        return parts[0], parts[1]

    def _edge(self, rank: int, side: int) -> list[tuple[bytes, int]]:
        """The parts that stood at the token's left (0) or right (1) end while it was made, each with the rank at which it merged into the next."""
        token, found, until = self.tokens[rank], [], _NEVER
        while True:
            found.append((token, until))
            if len(token) == 1:
                return found
            until, token = self.ranks[token], self.halves(token)[side]

    def _made(self, rank: int) -> bool:
        token = self.tokens[rank]
        return len(token) == 1 or self.halves(token) is not None

    def _fits(self, left: int, right: int) -> bool:
        """Whether both tokens stay as they are side by side: no merge over the place between them comes first.  Of equal ranks the leftmost merges first.

        A token that no merges make stays nowhere; START stands before the first token and merges with none.
        """
        if not self._made(right):
            return False
        if left == START:
            return True
        ranks, rights = self.ranks, self.edge(right, 0)
        for a, a_until in self.edge(left, 1):
            for b, b_until in rights:
                rank = ranks.get(a + b)
                if rank is not None and rank < a_until and rank <= b_until:
                    return False
        return True


class Prefixes:
    """A byte string and the last token of each of its prefixes; it can be appended to and changed anywhere."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", [START]
        self.append(data)

    def append(self, more: bytes) -> None:
        first = len(self.data)
        self.data += more
        self._fill(first, len(self.data))

    def _fill(self, first: int, stop: int) -> None:
        """Adds the entries of the prefixes that end with the bytes ``first`` to ``stop - 1``."""
        v, last, fits = self.vocabulary, self.last, self.vocabulary.fits
        base = max(0, first - v.longest + 1)
        need = first - base
        for end, (token, before) in v.ends.iter(self.data[base:stop].decode("latin-1")):
            # Tokens that end at one byte come one after the other; the first that fits is the only one.
            if end == need and fits(last[base + end - before], token):
                last.append(token)
                need += 1
        if base + need != stop:
            raise ValueError(f"no token ends at byte {base + need}")

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts ``new`` in the place of the bytes from ``start`` to ``end``; returns how many entries were filled in."""
        old, moved, step = self.last, len(new) - (end - start), self.vocabulary.longest
        self.data, self.last = self.data[:start] + new + self.data[end:], old[: start + 1]
        at = start + len(new)
        self._fill(start, at)
        while at < len(self.data):
            stop = min(at + step, len(self.data))
            self._fill(at, stop)
            same = self.last[at + 1 :] == old[at + 1 - moved : stop + 1 - moved]
            at = stop
            if same:
                self.last += old[at + 1 - moved :]
                break
        return at - start

    def become(self, data: bytes) -> None:
        """Another byte string; entries of the bytes that both begin with stay."""
        same = len(commonprefix((self.data, data)))
        del self.last[same + 1 :]
        self.data = data[:same]
        self.append(data[same:])

    def ids(self, length: int | None = None) -> list[int]:
        """The tokens of the first ``length`` bytes, of all without it."""
        found, at, tokens = [], len(self.data) if length is None else length, self.vocabulary.tokens
        while at > 0:
            token = self.last[at]
            found.append(token)
            at -= len(tokens[token])
        return found[::-1]


def _every() -> str:
    return "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def _members(escape: str) -> str:
    r"""The characters of ``\p{L}``, ``\p{N}`` or ``\s`` by the Unicode tables of the library whose ids are wanted."""
    ranks = {bytes([i]): i for i in range(256)}
    return bytes(tiktoken.Encoding("class", pat_str=escape, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(_every())).decode()


def _ranges(members: str) -> str:
    found = sorted(map(ord, members))
    cuts = [i for i in range(1, len(found)) if found[i] != found[i - 1] + 1]
    return "".join(f"\\U{found[a]:08x}-\\U{found[b - 1]:08x}" for a, b in zip([0, *cuts], [*cuts, len(found)]))


class Cutter:
    """Cuts by a pattern as that library does.

    The quick pattern's library has tables of its own, of another version of Unicode; a text with a character on which the
    two differ is cut by the same pattern with its classes written out.
    """

    def __init__(self, pattern: str):
        members = {escape: _members(escape) for escape in (r"\p{L}", r"\p{N}", r"\s")}
        self.quick = regex.compile(pattern)
        differ = set().union(*(set(m) ^ set(regex.findall(escape, _every())) for escape, m in members.items()))
        self.disputed = re.compile(f"[{_ranges(''.join(differ))}]" if differ else r"(?!)")
        # Bytes that no disputed character begins with, if all of those lie beyond the first bytes of UTF-8.
        self.undisputed = bytes(range(min(differ).encode()[0])) if differ else bytes(range(256))
        classes = {escape: _ranges(m) for escape, m in members.items()}
        classes[r"\S"] = "^" + classes[r"\s"]
        out, inside = [], False
        for part in re.split(r"(\\p\{[LN]\}|\\[sS]|\\.|[\[\]])", pattern):
            if part in classes:
                if inside and part == r"\S":
                    raise ValueError(r"\S within brackets")
                out.append(classes[part] if inside else f"[{classes[part]}]")
            else:
                inside = part == "[" or inside and part != "]"
                out.append(part)
        self.exact = re.compile("".join(out))

    def of(self, text: str):
        """The pattern that cuts this text right."""
        if text.isascii() or not text.encode().translate(None, self.undisputed):
            return self.quick
        return self.exact if self.disputed.search(text) else self.quick


class PatternEncoder:
    """Texts to ids and back, for one rank file and one pattern whose matches cover every text.

    Texts are taken some at a time.  The matches among them that are not known are encoded in byte order, by one table that
    keeps what a match has in common with the one before.
    """

    def __init__(self, key: tuple[str, str], memory: int = MEMORY):
        path, pattern = key
        self.vocabulary, self.cutter, self.memory = Vocabulary(path), Cutter(pattern), memory
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _learn(self, matches: set[str]) -> None:
        table, ranks = Prefixes(self.vocabulary), self.vocabulary.ranks
        for data in sorted(m.encode() for m in matches):
            if data in ranks:
                ids = [ranks[data]]
            else:
                table.become(data)
                ids = table.ids()
            packed = pack(f"<{len(ids)}I", *ids)
            self.known[data.decode()] = packed
            self.held += len(data) + len(packed) + ENTRY

    def matches(self, text: str, start: int = 0, window: int = WINDOW) -> Iterator[list[str]]:
        """The matches from ``start`` on, some at a time.  A match near the end of a window waits for the next, as what follows may change it."""
        wide, pattern = window, self.cutter.of(text)
        while start < len(text):
            end = min(len(text), start + wide)
            found, at = pattern.findall(text, start, end), end
            if end < len(text):
                while found and at + REACH > end:
                    at -= len(found.pop())
                if not found:
                    wide *= 2
                    continue
            yield found
            start, wide = at, window

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        made: list[list[bytes]] = []
        held: list[tuple[int, list[str]]] = []

        def settle() -> None:
            if self.held > self.memory:
                self.known, self.held = {}, 0
            self._learn(set().union(*(found for _, found in held)).difference(self.known))
            for at, found in held:
                made[at].append(b"".join(map(self.known.__getitem__, found)))
            held.clear()

        size = 0
        for text in texts:
            made.append([])
            for found in self.matches(text):
                held.append((len(made) - 1, found))
                size += len(found)
                if size > TOGETHER:
                    settle()
                    # All texts but the last are whole.
                    yield from map(b"".join, made[:-1])
                    made, size = made[-1:], 0
        settle()
        yield from map(b"".join, made)


class Decoder:
    """Ids back to bytes; it holds the tokens alone."""

    def __init__(self, path: str):
        self.tokens = {rank: token for token, rank in read_ranks(path).items()}

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class EditableText:
    """A text with its ids, kept up to date near each change: matches that no change reaches keep their tables."""

    def __init__(self, encoder: PatternEncoder, text: str = ""):
        self.encoder, self.text, self.parts = encoder, "", []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Puts ``new`` in the place of the characters from ``start`` to ``end``; returns how many matches were made anew."""
        moved, old = len(new) - (end - start), self.parts
        self.text = self.text[:start] + new + self.text[end:]
        at, keep = 0, 0
        while keep < len(old) and at + len(old[keep][0]) + REACH <= start:
            at += len(old[keep][0])
            keep += 1
        starts, place = {}, at
        for i in range(keep, len(old)):
            if place >= end:
                starts[place + moved] = i
            place += len(old[i][0])
        made: list[tuple[str, Prefixes]] = []
        tail = []
        for found in self.encoder.matches(self.text, at, 256):
            for match in found:
                if at >= start + len(new) and at in starts:
                    tail = old[starts[at] :]
                    break
                made.append((match, self._table(match, old[keep : keep + 1] if not made else [])))
                at += len(match)
            else:
                continue
            break
        self.parts = old[:keep] + made + tail
        return len(made)

    def _table(self, match: str, former: list) -> Prefixes:
        """A table for a match; one that begins as the former match at its place did goes on from the former table."""
        data = match.encode()
        for _, table in former:
            if data.startswith(table.data):
                table.append(data[len(table.data) :])
                return table
        return Prefixes(self.encoder.vocabulary, data)

    def ids(self) -> list[int]:
        ranks = self.encoder.vocabulary.ranks
        return [i for _, table in self.parts for i in ([ranks[table.data]] if table.data in ranks else table.ids())]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(low, ROWS) for batch in batches for low in range(0, batch.num_rows, ROWS))


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids), one row for each row of ``docs``; ids are little-endian unsigned 32-bit integers in one binary.

    A null or empty text has no ids.  Repeated rows are encoded each for itself, equal texts alike; an empty table gives no
    rows.  Special tokens are ordinary text.  Nothing is shuffled; a match takes time in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker(PatternEncoder, (ranks, pattern))
        for batch in _slices(batches):
            ids = list(coder.encode(x.as_py().decode() for x in batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array((len(x) // 4 for x in ids), pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (doc_id, n_tokens, ids) with the bytes that the ids stand for, as column decoded.  Null ids stand for none; an id that the file lacks raises KeyError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker(Decoder, ranks)
        for batch in _slices(batches):
            texts = pa.array((coder.decode(x.as_py() or b"") for x in batch.column("ids")), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_tokens", "ids")), texts], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
