"""Column names: canonical, unique, and mapped back to what the source had."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..config import InvalidRequest


def canonical(header: str) -> str:
    """Lower case, runs of other than ASCII letters and digits as one underscore, none at the ends."""
    return re.sub(r"[^a-z0-9]+", "_", header.strip().lower()).strip("_") or "column"


def canonical_headers(headers: list[str]) -> list[str]:
    """Canonical names; repeats get _2, _3 and so on, whichever is free, so the result is always unique."""
    taken: set[str] = set()
    out = []
    for name in map(canonical, headers):
        n, free = 1, name
        while free in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free)
        out.append(free)
    return out


def csv_names(headers: list[str | None]) -> list[str]:
    """Names of a CSV header before they are made canonical: blanks by their place, repeats (in any case) with a number behind."""
    taken: set[str] = set()
    out = []
    for i, header in enumerate(headers):
        name = header if header and header.strip() else f"column{i}"
        n, free = 0, name
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out.append(free)
    return out


def raw_to_canonical(headers: list[str]) -> dict[str, str]:
    """Canonical name of each raw header; a repeated raw header is keyed header#2, header#3."""
    seen: dict[str, int] = {}
    out = {}
    for raw, name in zip(headers, canonical_headers(headers)):
        seen[raw] = seen.get(raw, 0) + 1
        out[raw if seen[raw] == 1 else f"{raw}#{seen[raw]}"] = name
    return out


def with_canonical_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*canonical_headers(df.columns))


def renamed(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    """The columns under the canonical form of the names asked for; a column that is not there, or two of one name, is an error."""
    missing = sorted(set(renames) - set(df.columns))
    if missing:
        raise InvalidRequest(f"no such columns: {', '.join(missing)}")
    names = [canonical(renames[c]) if c in renames else c for c in df.columns]
    if len(set(names)) < len(names):
        raise InvalidRequest("two columns would have one name")
    return df.toDF(*names)
