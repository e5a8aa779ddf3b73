"""Booleans, codes, categories and structured strings."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import full_match, trim

#: Words for true and for false, in pairs.
BOOLEAN_PAIRS = (
    ("true", "false"), ("yes", "no"), ("1", "0"), ("t", "f"), ("y", "n"), ("on", "off"), ("active", "inactive"), ("enabled", "disabled"), ("checked", "unchecked"), ("pass", "fail"), ("ok", "nok"), ("paid", "unpaid"),
    ("oui", "non"), ("si", "no"), ("ja", "nein"), ("sim", "nao"), ("vero", "falso"), ("wahr", "falsch"),
)
TRUE_WORDS, FALSE_WORDS = (tuple(pair[i] for pair in BOOLEAN_PAIRS) for i in (0, 1))

#: Shapes of structured strings.
EMAIL = r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
URL = r"https?://[^\s/$.?#].[^\s]*"
PHONE = r"\+[1-9][0-9]{7,14}"


def to_boolean(c: Column) -> Column:
    word = F.lower(trim(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def as_code(c: Column, upper: bool = True) -> Column:
    """The text as a code is written; whether it is one, a look-up in ``code_table`` says."""
    return (F.upper if upper else F.lower)(trim(c))


def to_code(c: Column, allowed, upper: bool = True) -> Column:
    """The code, null unless it is one of a few that stand in the plan."""
    return F.when(as_code(c, upper).isin(*allowed), as_code(c, upper))


def to_category(c: Column, canonical) -> tuple[Column, Column]:
    """(the canonical spelling, or the trimmed value itself if unknown; whether it is known).  The first spelling wins."""
    chosen: dict[str, str] = {}
    for value in canonical:
        chosen.setdefault(value.strip().lower(), value)
    if not chosen:
        return trim(c), F.lit(False)
    found = F.create_map(*(F.lit(x) for pair in chosen.items() for x in pair))[F.lower(trim(c))]
    return F.coalesce(found, trim(c)), found.isNotNull()


def to_email(c: Column) -> Column:
    return F.when(full_match(F.lower(trim(c)), EMAIL), F.lower(trim(c)))


def to_url(c: Column) -> Column:
    return F.when(full_match(trim(c), URL), trim(c))


def _is_ipv4(bare: Column) -> Column:
    """Four numbers up to 255; of three digits none begins with a zero."""
    octet = lambda x: x.rlike(r"\A[0-9]{1,3}\z") & (x.try_cast("int") <= 255) & ~((F.length(x) == 3) & x.startswith("0"))
    groups = F.split(bare, r"\.", -1)
    return (F.size(groups) == 4) & F.forall(groups, octet)


def _is_ipv6(bare: Column) -> Column:
    """Eight groups of one to four hexadecimal digits, or fewer with one '::' in place of the missing ones."""
    group = lambda x: x.rlike(r"\A[0-9A-Fa-f]{1,4}\z")
    count = lambda side: F.when(side == "", 0).when(F.forall(F.split(side, ":", -1), group), F.size(F.split(side, ":", -1))).otherwise(9)
    sides = F.split(bare, "::", -1)
    return F.when(F.size(sides) == 1, count(bare) == 8).when(F.size(sides) == 2, count(F.get(sides, F.lit(0))) + count(F.get(sides, F.lit(1))) <= 7).otherwise(F.lit(False))


def to_ip(c: Column, version: str = "any") -> Column:
    bare = trim(c)
    said = {"v4": _is_ipv4(bare), "v6": _is_ipv6(bare), "any": F.when(bare.contains(":"), _is_ipv6(bare)).otherwise(_is_ipv4(bare))}[version]
    return F.when(said, bare)


def to_phone(c: Column) -> Column:
    bare = F.regexp_replace(trim(c), r"[\s().-]", "")
    return F.when(full_match(bare, PHONE), bare)


#: The folder of the iso-codes data files; this setting names another one.
ISO_FOLDER, ISO_SETTING = "/usr/share/iso-codes/json", "spark.grainmill.isoCodes"
#: File, list and field of each set of codes.
ISO_FILES = {
    "country_alpha_2": ("iso_3166-1.json", "3166-1", "alpha_2"), "country_alpha_3": ("iso_3166-1.json", "3166-1", "alpha_3"), "currency": ("iso_4217.json", "4217", "alpha_3"),
    "language_alpha_2": ("iso_639-3.json", "639-3", "alpha_2"), "language_alpha_3": ("iso_639-3.json", "639-3", "alpha_3"),
}


def iso_codes(kind: str) -> frozenset[str]:
    """The codes of a kind in ISO_FILES, from the folder that the session names; where the driver lacks it, those of the Java runtime."""
    spark = SparkSession.getActiveSession()
    return _iso_codes(kind, spark.conf.get(ISO_SETTING, ISO_FOLDER))


#: Sets of codes up to this size are broadcast; a larger one is joined as Spark sees fit.
MAX_BROADCAST_CODES = 100_000


def code_table(spark: SparkSession, kind: str) -> DataFrame:
    """The codes of a kind as a table of one column, ``code``, each once."""
    found = sorted(iso_codes(kind))
    table = spark.createDataFrame(pa.table({"code": pa.array(found, pa.string())}))
    return F.broadcast(table) if len(found) <= MAX_BROADCAST_CODES else table


@lru_cache
def _iso_codes(kind: str, folder: str) -> frozenset[str]:
    name, listed, field = ISO_FILES[kind]
    try:
        with open(f"{folder}/{name}", encoding="utf-8") as f:
            return frozenset(x[field] for x in json.load(f)[listed] if field in x)
    except FileNotFoundError:
        return _runtime_codes(kind)


def _runtime_codes(kind: str) -> frozenset[str]:
    """Three-letter language codes are those of languages that have a two-letter code too; currencies are those of some country."""
    util = SparkSession.getActiveSession().sparkContext._jvm.java.util
    countries = [util.Locale("", c) for c in util.Locale.getISOCountries()]
    if kind == "currency":
        used = (util.Currency.getInstance(c) for c in countries)
        return frozenset(x.getCurrencyCode() for x in used if x is not None)
    made = {
        "country_alpha_2": lambda: (x.getCountry() for x in countries),
        "country_alpha_3": lambda: (x.getISO3Country() for x in countries),
        "language_alpha_2": lambda: (x for x in util.Locale.getISOLanguages() if len(x) == 2),
        "language_alpha_3": lambda: (util.Locale(x).getISO3Language() for x in util.Locale.getISOLanguages()),
    }
    return frozenset(made[kind]())
