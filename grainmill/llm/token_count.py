"""Token counts of whole texts by overlap resynchronisation.

A text of more than CHUNK + OVERLAP characters is encoded in chunks that begin CHUNK apart and overlap.  Both chunks'
tokens carry their offsets; inside the overlap a place is sought at which a token of either chunk starts and which is a
proven boundary of the tokenizer: a space, tab or line end behind a character that is not white space.  The pattern of
byte-level BPE lets white space join what stands after it, and none join what stands before, whatever stands further off;
so up to there the earlier chunk's tokens are those of the whole text, and from there on the later chunk's.  Where the two
lists have no such place in common the overlap is doubled, up to the whole rest of the text, and the chunk after the splice
begins at the boundary found, so that no stretch is encoded again and again.  The count is the length of the spliced list.
A shorter text is one chunk.

A chunk is small against most documents, so they are all counted in this way, and a worker holds two chunks' tokens at a
time however long a document is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Encoding, Tokenizer

from .tokens import load, worker

#: Characters of a chunk and of the first overlap.
CHUNK, OVERLAP = 1 << 10, 1 << 6
LIMIT = 1024

_STABLE = re.compile(r"(?<=\S)[ \t\n\r\f\v]")


def spliced(text: str, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[Encoding, int, int]]:
    """(encoding, first, end): the tokens first to end - 1 of each encoding, one after the other, are those of the whole text."""

    def encode(low: int, high: int) -> Encoding:
        return tokenizer.encode(text[low:high], add_special_tokens=False)

    at, first, wide = 0, 0, overlap
    now = encode(0, chunk + overlap)
    while at + chunk + wide < len(text):
        low, high = at + chunk, at + chunk + wide
        later = encode(low, low + chunk + wide)
        place = _common(text, at, low, high, now, later)
        if place is None:
            wide *= 2
            now = encode(at, at + chunk + wide)
            continue
        end, begin, found = place
        yield now, first, end
        if wide == overlap:
            at, first, now = low, begin, later
        else:
            at, first, now, wide = found, 0, encode(found, found + chunk + overlap), overlap
    yield now, first, len(now)


def _common(text: str, at: int, low: int, high: int, now: Encoding, later: Encoding) -> tuple[int, int, int] | None:
    """The tokens of the earlier and of the later chunk that start at the same proven boundary in the overlap, the first such; and the boundary.

    The character after the boundary lies in both chunks, and so does the one before it.
    """
    for m in _STABLE.finditer(text, low + 1, high - 1):
        a, b = now.char_to_token(m.start() - at), later.char_to_token(m.start() - low)
        if a is not None and b is not None and now.token_to_chars(a)[0] == m.start() - at and later.token_to_chars(b)[0] == m.start() - low:
            return a, b, m.start()
    return None


def count_tokens(text: str, tokenizer: Tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of the whole text."""
    return sum(end - first for _, first, end in spliced(text, tokenizer, chunk, overlap))


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), one row for each row of ``docs``; ``tokenizer`` is the path of a byte-level BPE file.

    Null texts count as empty, with no tokens.  Whole texts are counted; nothing is shuffled.  Repeated rows count each
    for itself; an empty table gives no rows.  A text without any proven boundary, however long, is one chunk in the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker(load, tokenizer)
        for batch in batches:
            counts = [count_tokens(x.as_py(), coder) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.octet_length(text).cast("bigint").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
