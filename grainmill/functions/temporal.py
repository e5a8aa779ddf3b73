"""Dates, datetimes and times by layout: what is left of a value without its digits says what its numbers are.

``2023-01-03 04:05`` has the layout ``-- :`` and five numbers.  A layout of n separators with n + 1 numbers has one
separator in each gap, so no pattern has to be matched: each layout names the places of year, month, day and clock, and the
lengths of the numbers are checked.  No formatter is involved, so there is no locale and no error to catch.

A value is cut once: ``stages`` gives the cuts as columns, ``Cut`` holds them, and all readings of a value share them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import named

#: Serial day numbers that spreadsheets write, and the day they count from.
FIRST_SERIAL, LAST_SERIAL, SERIAL_EPOCH = 20000, 59999, "1899-12-30"
MIN_YEAR = 1000
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_BLANKS = " \t\n\x0b\f\r"
_SERIAL = r"\A[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?\z"

#: Layouts of dates whose year may come first, of dates in the column's order, and of clocks behind either.
YEAR_FIRST = ("--", "//")
ORDERED = ("--", "//", "..")
CLOCKS = (":", "::")


class Cut(NamedTuple):
    """text: the value with single blanks; layout: without digits; numbers: the runs of digits.

    ymd, dmy and mdy: the date of the first three numbers in that order, with four digits of the year for ymd and one to
    four for the others; named_dmy and named_mdy: the date with a month's name; seconds: of the day, by the clock from the
    fourth number on; serial: a spreadsheet's day number.
    """

    text: Column
    layout: Column
    numbers: Column
    ymd: Column | None = None
    dmy: Column | None = None
    mdy: Column | None = None
    named_dmy: Column | None = None
    named_mdy: Column | None = None
    seconds: Column | None = None
    serial: Column | None = None


def _text(c: Column) -> Column:
    bare = F.btrim(c, F.lit(_BLANKS))
    return F.when(bare.rlike(r"\s\s|[\t\n\x0B\f\r]"), F.regexp_replace(bare, r"\s+", " ")).otherwise(bare)


def _layout(text: Column) -> Column:
    return F.translate(text, "0123456789", "")


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0))


def _derived(x: Cut) -> dict[str, Column]:
    three = F.size(x.numbers) >= 3
    return {
        "ymd": F.when(three, _read(x, _YMD)), "dmy": F.when(three, _read(x, _DMY, None, True)), "mdy": F.when(three, _read(x, _MDY, None, True)),
        "named_dmy": _named(x, True), "named_mdy": _named(x, False), "seconds": F.when(F.size(x.numbers) >= 5, _clock(x, 3)), "serial": _serial(x),
    }


def cut(c: Column) -> Cut:
    text = _text(c)
    x = Cut(text, _layout(text), _numbers(text))
    return x._replace(**_derived(x))


def stages(c: Column, name: str) -> tuple[Cut, list[dict[str, Column]]]:
    """The cut as references to columns, and the levels of columns to compute first; those that are not read are pruned."""
    own = lambda part: f"__{part}__{name}"
    x = Cut(*(named(own(part)) for part in Cut._fields))
    return x, [{own("text"): _text(c)}, {own("layout"): _layout(x.text), own("numbers"): _numbers(x.text)}, {own(k): v for k, v in _derived(x).items()}]


class Fields(NamedTuple):
    """Where a layout has its year, month and day among the numbers; month None: the layout names it."""

    year: int
    month: int | None
    day: int


_YMD, _DMY, _MDY = Fields(0, 1, 2), Fields(2, 1, 0), Fields(2, 0, 1)


def _number(x: Cut, at: int) -> Column:
    return F.get(x.numbers, F.lit(at))


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date of three numbers, null if there is none."""
    ok = (year >= 0) & (year <= 9999) & month.between(1, 12) & day.between(1, 31)
    first = F.make_date(year, month, F.lit(1))
    return F.when(ok, F.when(day <= F.dayofmonth(F.last_day(first)), F.date_add(first, day - 1)))


def _fits(x: Cut, at: Fields, short_year: bool) -> Column:
    length = lambda i: F.length(_number(x, i))
    year = length(at.year) <= 4 if short_year else length(at.year) == 4
    return year & (length(at.day) <= 2) & (F.lit(True) if at.month is None else length(at.month) <= 2)


def _read(x: Cut, at: Fields, month: Column | None = None, short_year: bool = False) -> Column:
    value = lambda i: _number(x, i).try_cast("int")
    return F.when(_fits(x, at, short_year), _day(value(at.year), value(at.month) if month is None else month, value(at.day)))


def _named(x: Cut, day_first: bool) -> Column:
    """The date with the month's name: ``3 Jan 2023`` or ``Jan 3, 2023``."""
    name = F.substring(x.layout, 2, 3) if day_first else F.substring(x.layout, 1, 3)
    at = F.instr(F.lit(MONTHS.lower()), F.lower(name))
    month = F.when(F.pmod(at, F.lit(3)) == 1, ((at + 2) / 3).cast("int"))
    if day_first:
        shaped = (F.length(x.layout) == 5) & x.layout.startswith(" ") & x.layout.endswith(" ")
    else:
        shaped = x.layout.substr(4, 3).isin("  ", " , ") & ~x.text.contains(" ,")
    return F.when(shaped & (F.size(x.numbers) == 2), _read(x, Fields(1, None, 0), month, True))


def _in_order(x: Cut, day_first: bool) -> Column:
    """The date in the column's own order, by numbers or with a name, with a year of any length."""
    return F.when(x.layout.isin(*ORDERED) & (F.size(x.numbers) == 3), x.dmy if day_first else x.mdy).otherwise(x.named_dmy if day_first else x.named_mdy)


def _clock(x: Cut, first: int) -> Column:
    """Seconds of the day of the clock whose numbers begin at ``first``; null if there is none such."""
    value = lambda i: _number(x, i).try_cast("int")
    short = lambda i: F.coalesce(F.length(_number(x, i)), F.lit(0)) <= 2
    second = F.coalesce(value(first + 2), F.lit(0))
    ok = short(first) & short(first + 1) & short(first + 2) & (value(first) <= 23) & (value(first + 1) <= 59) & (second <= 59)
    return F.when(ok, value(first) * 3600 + value(first + 1) * 60 + second)


def _with_clock(dates: tuple[str, ...], gap: str, clocks=CLOCKS) -> list[str]:
    return [d + gap + k for d in dates for k in clocks]


def _has_clock(x: Cut, layouts: list[str]) -> Column:
    """Each of these layouts has as many separators as gaps, so the count of numbers is all that is left to check."""
    return x.layout.isin(*layouts) & (F.size(x.numbers) == F.length(x.layout) + 1)


def _serial(x: Cut) -> Column:
    number = F.when(x.text.rlike(_SERIAL), x.text.try_cast("double"))
    return F.when(number.between(FIRST_SERIAL, LAST_SERIAL), number)


def _late_enough(date: Column) -> Column:
    return F.when(F.year(date) >= MIN_YEAR, date)


def date_of(x: Cut, day_first: bool = False) -> Column:
    """A date: year first, in the order given, with a clock that is dropped, or a spreadsheet's serial day."""
    # In a date column a clock after T has seconds.
    clocked = _has_clock(x, _with_clock(("--",), " ") + ["--T::"])
    first = x.layout.isin(*YEAR_FIRST) & (F.size(x.numbers) == 3)
    text = F.coalesce(F.when(first, x.ymd), F.when(clocked & x.seconds.isNotNull(), x.ymd), _in_order(x, day_first))
    # What has the layout of a serial number has that of no date.
    return F.coalesce(_late_enough(text), F.date_add(F.to_date(F.lit(SERIAL_EPOCH)), F.floor(x.serial).cast("int")))


def datetime_of(x: Cut, day_first: bool = False) -> Column:
    """A timestamp without zone; a year-first date alone is midnight; serial days may have a fraction."""
    # T follows a hyphenated date with its year first only.
    clocked = _has_clock(x, _with_clock(YEAR_FIRST, " ") + _with_clock(("--",), "T"))
    bare = x.layout.isin(*YEAR_FIRST) & (F.size(x.numbers) == 3)
    ordered = F.when(clocked & ~x.layout.contains("T"), x.dmy if day_first else x.mdy)
    date = _late_enough(F.coalesce(F.when(bare | clocked, x.ymd), ordered))
    seconds = F.when(bare, F.lit(0)).otherwise(x.seconds)
    at = lambda day, s: day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))
    micros = F.round(x.serial * 86_400_000_000).cast("bigint")
    return F.coalesce(at(date, seconds), at(F.to_date(F.lit(SERIAL_EPOCH)), (micros / 1_000_000).cast("decimal(18,6)")))


def time_of(x: Cut) -> Column:
    """HH:mm:ss; a 12-hour clock needs AM or PM behind a blank, a 24-hour clock must not have it."""
    half = F.upper(x.layout).isin(": AM", ": PM", ":: AM", ":: PM") & x.text.rlike(r"\d [A-Za-z]{2}\z")
    counted = F.size(x.numbers) == F.when(F.substring(x.layout, 1, 2) == "::", 3).otherwise(2)
    hour = _number(x, 0).try_cast("int")
    turned = (F.pmod(hour, F.lit(12)) - hour + F.when(F.upper(x.layout).endswith("PM"), 12).otherwise(0)) * 3600
    seconds = F.when(x.layout.isin(*CLOCKS), _clock(x, 0)).when(half & hour.between(1, 12), _clock(x, 0) + turned)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(counted & seconds.isNotNull(), F.concat_ws(":", two(F.floor(seconds / 3600)), two(F.floor(F.pmod(seconds, F.lit(3600)) / 60)), two(F.pmod(seconds, F.lit(60)))))


def date_order_of(x: Cut, day_first: bool) -> Column:
    """Whether the value reads as a date in that order, with a year of any length; year-first values and serials tell nothing."""
    return _in_order(x, day_first).isNotNull()


def datetime_order_of(x: Cut, day_first: bool) -> Column:
    return _has_clock(x, _with_clock(YEAR_FIRST, " ")) & x.seconds.isNotNull() & (x.dmy if day_first else x.mdy).isNotNull()


def to_date(c: Column, day_first: bool = False) -> Column:
    return date_of(cut(c), day_first)


def to_datetime(c: Column, day_first: bool = False) -> Column:
    return datetime_of(cut(c), day_first)


def to_time(c: Column) -> Column:
    return time_of(cut(c))


def date_order(c: Column, day_first: bool) -> Column:
    return date_order_of(cut(c), day_first)


def datetime_order(c: Column, day_first: bool) -> Column:
    return datetime_order_of(cut(c), day_first)
