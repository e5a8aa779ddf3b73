"""What a run is told: column types, source formats and options.  Plain frozen dataclasses with a JSON form."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields
from typing import Any

from .functions.text import null_tokens

#: The semantic types, twelve core ones and two groups that extend them.
CORE_TYPES = ("string", "identifier", "boolean", "integer", "decimal", "currency", "percentage", "signed", "accounting", "date", "datetime", "time")
CODE_TYPES = ("country_code", "currency_code", "language_code")
CONFIRMED_TYPES = ("categorical", "email", "url", "ip_address", "phone")
TYPES = CORE_TYPES + CODE_TYPES + CONFIRMED_TYPES
DECIMAL_TYPES = ("decimal", "currency", "percentage", "signed", "accounting")
SIGNED_TYPES = ("signed", "accounting")
MONETARY_TYPES = ("currency", "accounting")
IDENTIFIER_KINDS = ("primary", "foreign", "business_key", "opaque")
#: Published columns that have a row's raw cells and its issues as variants.
RAW_VARIANT, ISSUES_VARIANT = "_raw_row_variant", "_parse_issues_variant"


class InvalidRequest(ValueError):
    """The caller asked for something that can't be done."""


class SourceError(InvalidRequest):
    """The source can't be read as declared."""


class InvalidState(RuntimeError):
    """The run is not at the step that this needs."""


class InstanceNotFound(KeyError):
    """There is no run of that id."""


@dataclass(frozen=True)
class ColumnConfig:
    """The type of one column and the options that its type has."""

    type: str = "string"
    identifier_kind: str = "opaque"
    cr_negative: bool = True
    day_first: bool = False
    code_format: str = "alpha_2"
    canonical_values: tuple[str, ...] = ()
    version: str = "any"

    def __post_init__(self):
        if self.type not in TYPES:
            raise InvalidRequest(f"unknown column type {self.type!r}")
        if self.identifier_kind not in IDENTIFIER_KINDS:
            raise InvalidRequest(f"unknown identifier kind {self.identifier_kind!r}")
        if self.code_format not in ("alpha_2", "alpha_3") or self.version not in ("any", "v4", "v6"):
            raise InvalidRequest("unknown code format or version")
        object.__setattr__(self, "canonical_values", tuple(self.canonical_values))

    def to_dict(self) -> dict[str, Any]:
        """The type with the options that matter for it."""
        own = {"identifier": ("identifier_kind",), "signed": ("cr_negative",), "accounting": ("cr_negative",), "date": ("day_first",), "datetime": ("day_first",), "country_code": ("code_format",), "language_code": ("code_format",), "categorical": ("canonical_values",), "ip_address": ("version",)}
        return {"type": self.type} | {k: list(v) if isinstance(v := getattr(self, k), tuple) else v for k in own.get(self.type, ())}

    @classmethod
    def from_dict(cls, said: dict[str, Any]) -> ColumnConfig:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in said.items() if k in known})


@dataclass(frozen=True)
class SourceFormat:
    """How a source is laid out.  header_row counts from 1; None: no header."""

    kind: str = "csv"
    header_row: int | None = 1
    delimiter: str = ","
    encoding: str = "utf-8"
    sheet: str | None = None

    def __post_init__(self):
        if self.kind not in ("csv", "json", "excel"):
            raise InvalidRequest(f"unknown source format {self.kind!r}")
        if self.header_row is not None and self.header_row < 1:
            raise InvalidRequest("INVALID_HEADER_ROW_INDEX")
        if self.kind == "csv" and len(self.delimiter) != 1:
            raise InvalidRequest("INVALID_DELIMITER")
        if self.kind == "csv" and self.encoding not in ("utf-8", "utf-8-sig", "latin-1", "utf-16"):
            raise InvalidRequest("UNSUPPORTED_ENCODING")


@dataclass(frozen=True)
class Thresholds:
    ready: float = 95.0
    warning: float = 85.0

    def __post_init__(self):
        if self.warning > self.ready:
            raise InvalidRequest("the warning threshold is above the ready threshold")


@dataclass(frozen=True)
class Options:
    """Options of profiling and conversion.  ``variants`` publishes raw cells and issues as two variants too, which are read by path."""

    null_tokens: tuple[str, ...] = ()
    drop_empty_rows: bool = True
    full_raw_row: bool = False
    trace_mode: tuple[str, ...] = ("issues",)
    approximate_unique: bool = False
    variants: bool = False
    thresholds: Thresholds = field(default_factory=Thresholds)

    def __post_init__(self):
        object.__setattr__(self, "null_tokens", null_tokens(self.null_tokens))
        object.__setattr__(self, "trace_mode", tuple(self.trace_mode))
        if not self.trace_mode or set(self.trace_mode) - {"issues", "changes", "full"}:
            raise InvalidRequest("trace_mode is a non-empty subset of issues, changes and full")


@dataclass(frozen=True)
class InstanceConfig:
    """Source format, columns by position key (A, B, ..., AA) and options."""

    columns: dict[str, ColumnConfig]
    source: SourceFormat = field(default_factory=SourceFormat)
    options: Options = field(default_factory=Options)

    def to_dict(self) -> dict[str, Any]:
        return {"source_format": asdict(self.source), "column_config": {k: c.to_dict() for k, c in self.columns.items()}, "operation_config": asdict(self.options)}

    @classmethod
    def from_dict(cls, said: dict[str, Any]) -> InstanceConfig:
        options = dict(said.get("operation_config") or {})
        if "thresholds" in options:
            options["thresholds"] = Thresholds(**options["thresholds"])
        return cls({k: ColumnConfig.from_dict(c) for k, c in said["column_config"].items()}, SourceFormat(**(said.get("source_format") or {})), Options(**options))

    def by_name(self, names: list[str]) -> dict[str, ColumnConfig]:
        """The columns by name; a column without a config is a string."""
        return {name: self.columns.get(position_key(i), ColumnConfig()) for i, name in enumerate(names)}


def position_key(index: int) -> str:
    """0: A, 25: Z, 26: AA."""
    key, n = "", index + 1
    while n:
        n, rest = divmod(n - 1, 26)
        key = chr(65 + rest) + key
    return key
