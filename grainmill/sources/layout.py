"""The layout of a source from its prefix: encoding, delimiter, header row, and whether its kind is what it says."""

from __future__ import annotations

import csv
import io
import json
import re
from collections import Counter

from ..config import SourceError, SourceFormat

DELIMITERS = ",;\t|"
SNIFF_CHARS, MODAL_ROWS, HEADER_ROWS = 128 * 1024, 20, 15
FIRST_OBJECT = 1 << 20
MAX_RAGGED = 0.10
#: Marks that stand between the digits of a number.
_BETWEEN_DIGITS = re.compile(r"[.,\s']")
csv.field_size_limit(1 << 30)  # cells may be as large as a prefix


def encoding_of(data: bytes) -> str:
    """By byte order mark, else UTF-8 if it decodes (a character cut off at the end does not count), else Latin-1."""
    if data.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16"
    for cut in range(4):
        try:
            data[: len(data) - cut].decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "latin-1"


def _rows(text: str, delimiter: str, limit: int) -> list[list[str]]:
    out = []
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter):
        if row:
            out.append(row)
        if len(out) == limit:
            break
    return out


def delimiter_of(text: str) -> str:
    """What the standard sniffer says, else the delimiter with the widest and steadiest rows."""
    try:
        return csv.Sniffer().sniff(text[:SNIFF_CHARS], DELIMITERS).delimiter
    except csv.Error:
        pass

    def score(d: str) -> int:
        widths = Counter(map(len, _rows(text, d, MODAL_ROWS)))
        width, times = widths.most_common(1)[0] if widths else (1, 0)
        return (width - 1) * times

    return max(DELIMITERS, key=score)


def cell_kind(cell: str | None) -> str:
    """blank, number (digits in groups, with a sign or none) or label."""
    bare = (cell or "").strip()
    if not bare:
        return "blank"
    groups = _BETWEEN_DIGITS.split(bare[1:] if bare[0] in "+-" else bare)
    return "number" if all(g.isdecimal() for g in groups) else "label"


def header_like(cells: list[str]) -> bool:
    """A header has labels and nothing else."""
    return {cell_kind(c) for c in cells} == {"label"}


def header_row_of(rows: list[list[str]]) -> int | None:
    """The topmost header-like row, from 1, among the first ones that are as wide as most."""
    widths = Counter(map(len, rows))
    for number, row in enumerate(rows[:HEADER_ROWS], 1):
        if widths[len(row)] == max(widths.values()) and header_like(row) and len(row) == widths.most_common(1)[0][0]:
            return number
    return None


def csv_layout(data: bytes) -> SourceFormat:
    encoding = encoding_of(data)
    text = data.decode(encoding, errors="ignore")
    delimiter = delimiter_of(text)
    try:
        named = csv.Sniffer().has_header(text[:SNIFF_CHARS])
    except csv.Error:
        named = False
    rows = _rows(text, delimiter, MODAL_ROWS)
    first = 1 if named and rows and header_like(rows[0]) and len(rows[0]) > 1 else header_row_of(rows)
    return SourceFormat("csv", first, delimiter, encoding)


def ragged_share(data: bytes, layout: SourceFormat) -> float:
    """The share of rows of the prefix whose width is not the header's."""
    rows = _rows(data.decode(layout.encoding, errors="ignore"), layout.delimiter, 10_000)[(layout.header_row or 1) - 1 :]
    return sum(len(r) != len(rows[0]) for r in rows) / len(rows) if rows else 0.0


def verify(data: bytes, layout: SourceFormat) -> None:
    """Raises SourceError if a declared CSV layout does not fit the prefix."""
    if layout.kind != "csv":
        return
    if ragged_share(data, layout) > MAX_RAGGED:
        raise SourceError("more than a tenth of the rows are not as wide as the header")
    rows = _rows(data.decode(layout.encoding, errors="ignore"), layout.delimiter, MODAL_ROWS)
    if rows and max(map(len, rows)) == 1 and any(d in rows[0][0] for d in DELIMITERS if d != layout.delimiter):
        raise SourceError("the declared delimiter leaves one column, another would not")


def check_kind(path: str, kind: str, data: bytes) -> None:
    """Raises SourceError if the file's ending or its first bytes do not go with its kind."""
    ending = {"csv": ".csv", "excel": ".xlsx", "json": ".json"}[kind]
    if not path.lower().endswith(ending):
        raise SourceError(f"a source of kind {kind} ends in {ending}")
    if kind == "excel" and not data.startswith(b"PK\x03\x04"):
        raise SourceError("not a spreadsheet file")
    if kind == "json" and not data.removeprefix(b"\xef\xbb\xbf").lstrip().startswith(b"["):
        raise SourceError("a JSON source is an array of objects")


def json_keys(data: bytes) -> list[str]:
    """The keys of the first object of a JSON array; every object of the prefix must have the same set."""
    text = data.decode("utf-8-sig", errors="ignore").lstrip()
    if not text.startswith("["):
        raise SourceError("a JSON source is an array of objects")
    decoder, at, keys = json.JSONDecoder(), 1, None
    while True:
        while at < len(text) and text[at] in " \t\r\n,":
            at += 1
        if at >= len(text) or text[at] == "]":
            break
        try:
            value, at = decoder.raw_decode(text, at)
        except json.JSONDecodeError as error:
            if keys is None:
                raise SourceError("the first object does not fit the prefix") from error
            break
        if not isinstance(value, dict):
            raise SourceError("a JSON source holds objects only")
        if keys is None:
            if at > FIRST_OBJECT:
                raise SourceError("the first object is too large")
            keys = list(value)
        elif set(keys) != set(value):
            raise SourceError("the objects do not all have the same keys")
    return keys or []
