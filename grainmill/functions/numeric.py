"""Numbers of mixed locales: every value's grouping and decimal separator follow from its own shape.

With both separators the later one is the decimal point.  A single separator is the decimal point if it does not leave
exactly three digits behind it, or if nothing but an optional sign and zero stands before it; else it groups thousands.
So ``12.345`` is 12345, ``0.345`` is 0.345 and ``1234.567`` is 1234567.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import count_char, full_match, without

#: Characters that only group digits.
GROUP_ONLY = "' \u00a0\u202f"
#: The largest precisions of decimals backed by 64 and 128 bits.
SMALL_PRECISION, LARGE_PRECISION = 18, 38

_WESTERN, _EUROPEAN, _INDIAN, _PLAIN = r"\d{1,3}(?:,\d{3})+", r"\d{1,3}(?:\.\d{3})+", r"\d{1,2}(?:,\d{2})+,\d{3}", r"\d+"
DECIMAL_PATTERN = rf"[+-]?(?:{_WESTERN}(?:\.\d*)?|{_EUROPEAN}(?:,\d*)?|{_INDIAN}(?:\.\d*)?|{_PLAIN}(?:[.,]\d*)?|[.,]\d+)"
INTEGER_PATTERN = rf"[+-]?(?:{_WESTERN}|{_EUROPEAN}|{_INDIAN}|{_PLAIN})"


def strip_groups(c: Column) -> Column:
    return without(c, GROUP_ONLY)


def is_decimal(clean: Column) -> Column:
    return full_match(clean, DECIMAL_PATTERN)


def is_integer(clean: Column) -> Column:
    return full_match(clean, INTEGER_PATTERN)


def _tail(clean: Column, sep: str) -> Column:
    """How many characters stand behind the last separator."""
    return F.instr(F.reverse(clean), sep) - 1


def _separates(clean: Column, sep: str, other: str) -> Column:
    lone = (_tail(clean, sep) != 3) | full_match(F.substring(clean, F.lit(1), F.length(clean) - _tail(clean, sep) - 1), "[+-]?0?")
    return (
        F.when((F.instr(clean, sep) > 0) & (F.instr(clean, other) > 0), _tail(clean, sep) < _tail(clean, other))
        .when(count_char(clean, sep) == 1, lone)
        .otherwise(F.lit(False))
    )


def comma_is_decimal(clean: Column) -> Column:
    return _separates(clean, ",", ".")


def dot_is_decimal(clean: Column) -> Column:
    return _separates(clean, ".", ",")


def decimal_separator(clean: Column) -> Column:
    """',' or '.', '' if the value has none."""
    return F.when(comma_is_decimal(clean), ",").when(dot_is_decimal(clean), ".").otherwise("")


def plain_decimal(clean: Column, separator: Column | None = None) -> Column:
    """The value with '.' as its decimal point and without grouping."""
    separator = decimal_separator(clean) if separator is None else separator
    return F.when(separator == ",", F.replace(without(clean, "."), F.lit(","), F.lit("."))).when(separator == ".", without(clean, ",")).otherwise(without(clean, ",."))


def plain_integer(clean: Column) -> Column:
    return without(clean, ",.")


def has_significant_digit(c: Column) -> Column:
    return c.rlike("[1-9]")


def significant_scale(converted: Column) -> Column:
    """Digits behind the point without trailing zeros."""
    return F.when(F.instr(converted, ".") > 0, F.length(F.rtrim(converted, F.lit("0"))) - F.instr(converted, ".")).otherwise(0)


def integer_digits(converted: Column) -> Column:
    """Digits before the point without sign and leading zeros."""
    return F.length(F.ltrim(F.ltrim(F.substring_index(converted, ".", 1), F.lit("+-")), F.lit("0")))


def decimal_type(max_scale: int, max_integer_digits: int) -> tuple[int, int]:
    """(precision, scale) that hold the column: 64 bits if they suffice; digits before the point go first."""
    precision = SMALL_PRECISION if max_scale + max_integer_digits <= SMALL_PRECISION else LARGE_PRECISION
    return precision, max(min(max_scale, precision - max_integer_digits), 0)


def to_integer(clean: Column) -> Column:
    """The value, or null: not a number or beyond 64 bits, which is seen without the error that a cast would raise and catch for each."""
    text = plain_integer(clean)
    wide = text.try_cast("decimal(38,0)")
    return F.when(is_integer(clean), F.when(F.length(text) <= 18, text.try_cast("bigint")).when(wide.between(F.lit(Decimal(-(1 << 63))), F.lit(Decimal((1 << 63) - 1))), wide.cast("bigint")))


def to_decimal(clean: Column, converted: Column, precision: int, scale: int) -> Column:
    """The value, or null: not a number, too large, or rounded to zero though it has a digit other than zero."""
    value = converted.try_cast(f"decimal({precision},{scale})")
    return F.when(is_decimal(clean) & ~((value == 0) & has_significant_digit(converted)), value)
