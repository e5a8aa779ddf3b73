"""What a cell becomes: for each column type, expressions in stages, a value and a valid flag.

A stage is computed once and read by name in the next one, so a cell is trimmed, cleaned and matched once though its value,
its issue and its row's error count all depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ColumnConfig
from ..functions import money, numeric, temporal, values
from ..functions.text import named, nullish, trim


@dataclass(frozen=True)
class Lookup:
    """A level that is a join: the column ``found`` has the code of the set ``kind`` that stands in the column ``key``, else null.

    The sets hold up to some thousand codes.  They are tables beside the plan, whose size doesn't depend on theirs.
    """

    key: str
    found: str
    kind: str

    def join(self, df: DataFrame) -> DataFrame:
        known = values.code_table(df.sparkSession, self.kind).withColumnRenamed("code", self.found)
        return df.join(known, named(self.key) == named(self.found), "left")


Level = dict[str, Column] | Lookup


@dataclass
class Cell:
    """stages: names and expressions, level by level.  value: the typed value; kept: a value that stays though it is flagged."""

    value: Column
    valid: Column
    stages: list[Level] = field(default_factory=list)


def number_stages(name: str, config: ColumnConfig) -> list[dict[str, Column]]:
    """Levels of columns up to __clean__name, the text of a number without currency, markers, percent sign and group marks; profiling and conversion share it."""
    c, stages = named(name), []
    if config.type == "percentage":
        text = money.percentage_candidate(c)
    elif config.type in ("currency", "signed", "accounting"):
        cut, stages = money.stages(c, name)
        text = money.candidate_of(cut, config.type, config.cr_negative)
    else:
        text = trim(c)
    return [*stages, {f"__clean__{name}": numeric.strip_groups(text)}]


def code_set(config: ColumnConfig) -> tuple[str, bool]:
    """The set of the allowed codes and whether they are upper case."""
    if config.type == "currency_code":
        return "currency", True
    return f"{config.type.removesuffix('_code')}_{config.code_format}", config.type == "country_code"


def cell(name: str, config: ColumnConfig, precision: int = 18, scale: int = 2) -> Cell:
    c, kind = named(name), config.type
    if kind == "string":
        return Cell(c, F.lit(True))
    if kind == "identifier":
        return Cell(trim(c), F.lit(True))
    own = lambda part: f"__{part}__{name}"
    ref = lambda part: named(own(part))
    if kind == "integer":
        return Cell(ref("value"), ref("value").isNotNull(), [{own("clean"): numeric.strip_groups(trim(c))}, {own("value"): numeric.to_integer(ref("clean"))}])
    if kind in ("decimal", "currency", "percentage", "signed", "accounting"):
        stages = [
            *number_stages(name, config),
            {own("sep"): numeric.decimal_separator(ref("clean"))},
            {own("norm"): numeric.plain_decimal(ref("clean"), ref("sep"))},
            {own("value"): numeric.to_decimal(ref("clean"), ref("norm"), precision, scale)},
        ]
        return Cell(ref("value"), ref("value").isNotNull(), stages)
    if kind == "categorical":
        value, known = values.to_category(c, config.canonical_values)
        return Cell(value, F.coalesce(known, F.lit(False)))
    if kind in ("country_code", "currency_code", "language_code"):
        kind, upper = code_set(config)
        return Cell(ref("value"), ref("value").isNotNull(), [{own("code"): values.as_code(c, upper)}, Lookup(own("code"), own("value"), kind)])
    elif kind in ("date", "datetime", "time"):
        cut, stages = temporal.stages(c, name)
        made = temporal.time_of(cut) if kind == "time" else (temporal.date_of if kind == "date" else temporal.datetime_of)(cut, config.day_first)
        return Cell(ref("value"), ref("value").isNotNull(), [*stages, {own("value"): made}])
    else:
        made = {
            "boolean": lambda: values.to_boolean(c),
            "email": lambda: values.to_email(c),
            "url": lambda: values.to_url(c),
            "ip_address": lambda: values.to_ip(c, config.version),
            "phone": lambda: values.to_phone(c),
        }[kind]()
    return Cell(ref("value"), ref("value").isNotNull(), [{own("value"): made}])


def staged(df: DataFrame, stages: list[list[Level]]) -> DataFrame:
    """The stages of all cells, one select a level, and a join for each look-up."""
    for level in range(max(map(len, stages), default=0)):
        now = [s[level] for s in stages if level < len(s)]
        df = df.withColumns({k: v for made in now if not isinstance(made, Lookup) for k, v in made.items()})
        for lookup in now:
            df = lookup.join(df) if isinstance(lookup, Lookup) else df
    return df


def issue_code(config: ColumnConfig) -> str:
    return f"INVALID_{config.type.upper()}"


def null_flag(name: str, tokens) -> Column:
    return nullish(named(name), tokens)
