"""Issues of a table and its columns, from profiles and the confirmed configuration."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from ..config import ColumnConfig, SourceFormat
from ..functions.money import words_of_sign

INFO, WARNING, ERROR = "INFO", "WARNING", "ERROR"
LOW_CONFIDENCE = 0.75


@dataclass(frozen=True)
class Issue:
    code: str
    severity: str
    column: str | None = None
    evidence: dict[str, Any] = field(default_factory=dict)


def dataset_issues(columns: Mapping[str, ColumnConfig], source: SourceFormat | None = None) -> list[Issue]:
    out = []
    if source and source.kind in ("csv", "excel") and (source.header_row or 1) > 1:
        out.append(Issue("PREAMBLE_ROWS_SKIPPED", INFO, evidence={"skipped_row_count": source.header_row - 1}))
    primary = [c for c, config in columns.items() if config.type == "identifier" and config.identifier_kind == "primary"]
    if len(primary) > 1:
        out.append(Issue("MULTIPLE_PRIMARY_KEYS", ERROR, evidence={"columns": primary}))
    return out


def column_issues(name: str, config: ColumnConfig, profile: Mapping[str, Any]) -> list[Issue]:
    out = []
    own = lambda *keys: {k: profile[k] for k in keys}
    if config.type == "identifier" and profile["duplicate_count"] > 0:
        severity = ERROR if config.identifier_kind == "primary" else WARNING
        out.append(Issue("IDENTIFIER_DUPLICATES", severity, name, own("duplicate_count", "distinct_count", "uniqueness_ratio")))
    if profile.get("mixed_symbols"):
        out.append(Issue("MIXED_CURRENCY", WARNING, name, own("symbol_distribution", "dominant_symbol", "dominant_symbol_ratio", "symbol_detected_ratio")))
    if profile.get("comma_decimal_count") and profile.get("dot_decimal_count"):
        out.append(Issue("MIXED_NUMBER_FORMAT", INFO, name, own("comma_decimal_count", "dot_decimal_count")))
    if profile.get("order_ambiguous_count") and not profile["order_decisive_count"]:
        out.append(Issue("DATE_ORDER_AMBIGUOUS", WARNING, name, own("order_ambiguous_count", "order_decisive_count") | {"day_first": config.day_first}))
    signs = profile.get("sign_notation_distribution", {})
    if signs.get("negative_marker") or signs.get("positive_marker"):
        negative, positive = words_of_sign(config.cr_negative)
        counts = {"negative_marker": negative, "positive_marker": positive, "negative_marker_count": signs.get("negative_marker", 0), "positive_marker_count": signs.get("positive_marker", 0)}
        out.append(Issue("SIGN_MARKER_CONVENTION", WARNING, name, counts | {"cr_negative": config.cr_negative}))
    return out


def confidence_issue(confidence: Mapping[str, float], threshold: float = LOW_CONFIDENCE) -> list[Issue]:
    low = {k: v for k, v in confidence.items() if v < threshold}
    return [Issue("LOW_CONFIDENCE", WARNING, evidence={"items": low, "threshold": threshold})] if low else []


def summary(issues: list[Issue]) -> dict[str, Any]:
    return {"total": len(issues), "by_severity": {s: sum(i.severity == s for i in issues) for s in (INFO, WARNING, ERROR)}}
