"""Personal data and secrets: patterns propose spans, checksums and entropy confirm them, context words nearby move the score."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

#: Words that make a kind likelier where they stand near a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "whatsapp"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "passphrase", "apikey", "api_key", "api-key", "api key", "access key", "access_key", "private_key", "auth", "bearer", "credential", "credentials", "key"),
}
#: How keys of well-known services and key files begin.
KEY_SHAPES = (r"AKIA[0-9A-Z]{16}", r"ASIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{35}", r"gh[pousr]_[0-9A-Za-z]{36}", r"glpat-[0-9A-Za-z_-]{20}", r"xox[abpr]-[0-9A-Za-z-]{10,100}", r"sk_live_[0-9A-Za-z]{16,100}", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", r"eyJ[0-9A-Za-z_-]{10,2000}\.eyJ[0-9A-Za-z_-]{10,2000}\.[0-9A-Za-z_-]{10,2000}")
#: Score of a span that only its pattern supports, and of one that a checksum or a range check confirms.
PROPOSED, CONFIRMED = 0.3, 0.6
NEAR, NEAR_BONUS = 40, 0.3
THRESHOLD = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# An earlier start inside a run of digits would give the same end, so a match may begin at the run's start alone.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_SHAPED = re.compile("(?<![0-9A-Za-z_])(?:" + "|".join(KEY_SHAPES) + ")")
_STRONG = re.compile(r"AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abpr]-|sk_live_|-----BEGIN|eyJ")
#: A value assigned to a name, and a long run of hexadecimal digits; either is a secret only beside a context word.
_ASSIGNED = re.compile(r"[=:]\s{0,4}[\"']?([0-9A-Za-z+/_.~!@#$%^&*-]{6,512})")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])")
LEAST_ENTROPY = 2.5
_WORD = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, words)) + r")(?![a-z])") for kind, words in CONTEXT.items()}


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    """Whether an IBAN without spaces has right check digits."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of a local part, '@' and a dotted domain; a match holds one '@', so each is looked at once."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)


def _proposed(text: str) -> Iterator[tuple[str, int, int, float, bool]]:
    for start, end in _emails(text):
        yield "email", start, end, CONFIRMED, True
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(int(x) <= 255 if len(x) < 10 else not x.strip("0") or int(x.lstrip("0")[:4]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            yield "ip", m.start(), m.end(), CONFIRMED, True
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), CONFIRMED, True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                yield "phone", m.start(), m.end(), CONFIRMED, True
    for m in _LOCAL_PHONE.finditer(text):
        yield "phone", m.start(), m.end(), PROPOSED, False
    for m in _IBAN.finditer(text):
        if 15 <= len(iban := m[0].replace(" ", "")) <= 34 and mod_97(iban):
            yield "iban", m.start(), m.end(), CONFIRMED, False
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", m.start(), m.end(), PROPOSED, False


def entropy(text: str) -> float:
    """Bits a character of the text's own distribution of characters."""
    return sum(n / len(text) * math.log2(len(text) / n) for n in Counter(text).values())


def _mixed(text: str) -> bool:
    """Whether a value looks drawn: letters and digits, and not a few characters over and over."""
    return bool(_DIGIT.search(text)) and any(c.isalpha() for c in text) and entropy(text) >= LEAST_ENTROPY


def _secrets(text: str) -> Iterator[tuple[str, int, int, float, bool]]:
    """Secrets, of overlapping ones the first and longest."""
    found = []
    if _STRONG.search(text):
        found += [(m.start(), m.end(), CONFIRMED) for m in _SHAPED.finditer(text)]
    if _DIGIT.search(text):
        if "=" in text or ":" in text:
            for m in _ASSIGNED.finditer(text):
                value = m[1].rstrip(".!")
                if len(value) >= 6 and _mixed(value):
                    found.append((m.start(1), m.start(1) + len(value), PROPOSED))
        found += [(m.start(), m.end(), PROPOSED) for m in _HEX.finditer(text) if _mixed(m[0])]
    last = -1
    for start, end, score in sorted(found, key=lambda x: (x[0], -x[1], -x[2])):
        if start >= last:
            yield "secret", start, end, score, False
            last = end


def find_spans(text: str | None) -> list[Span]:
    """Spans by start, then kind.  Base spans always stay; an added span needs the score THRESHOLD, and must not overlap a base span unless it is a secret, whose digits may look like a card or a number."""
    if not text:
        return []
    out: list[Span] = []
    for kind, start, end, score, base in (*_proposed(text), *_secrets(text)):
        around = text[max(0, start - NEAR) : start].lower() + " " + text[end : end + NEAR // 2].lower()
        score = min(1.0, score + NEAR_BONUS * bool(_WORD[kind].search(around)))
        out.append(Span(start, kind, end, score, base))
    kept = [s for s in out if s.base]
    taken = sorted((s.start, s.end) for s in kept)
    if any(not s.base for s in out):
        ends, most = [], 0
        for _, e in taken:
            ends.append(most := max(most, e))
        for s in out:
            if not s.base and s.score >= THRESHOLD:
                i = bisect.bisect_left(taken, (s.end, 0))
                if s.kind == "secret" or not i or ends[i - 1] <= s.start:
                    kept.append(s)
    return sorted(kept, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


SPANS = "array<struct<kind: string, start: bigint, end: bigint, score: double, base: boolean>>"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))
    for batch in batches:
        spans = [[{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score, "base": s.base} for s in find_spans(x.as_py())] for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), one row for each row of ``docs``; positions count code points, ends are exclusive.

    Null and empty texts have no spans.  Repeated rows are scored each for itself; nothing is shuffled.
    """
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_run, f"doc_id bigint, spans {SPANS}")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with each span replaced by its kind in brackets; of overlapping spans the first and longest counts.

    A null text stays null, an empty one empty.  Repeated rows are redacted each for itself; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for x in batch.column("text"):
                text, at, parts = x.as_py(), 0, []
                for s in sorted(find_spans(text), key=lambda s: (s.start, -s.end)):
                    if s.start >= at:
                        parts += [text[at : s.start], f"[{s.kind.upper()}]"]
                        at = s.end
                texts.append(None if text is None else "".join(parts) + text[at:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, text string")


def digest(spans: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, from the result of ``pii_spans``; then the counts of secrets and of all spans."""
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return spans.select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.size(F.filter("spans", lambda s: s["kind"] == "secret")).cast("bigint").alias("n_secret"), F.size("spans").cast("bigint").alias("n_spans"))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
