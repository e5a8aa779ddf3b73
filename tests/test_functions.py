"""Each rule of the column functions by a table of values."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from grainmill.config import ColumnConfig
from grainmill.functions import money, numeric, temporal, text, values
from grainmill.operators.convert import convert_cells


def apply(spark, made, cells):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r.v for r in df.select("i", made(F.col("c")).alias("v")).orderBy("i").collect()]


def convert(spark, cells, config, sizes=(18, 3), tokens=()):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    rows = convert_cells(df, {"c": config}, tokens, {"c": sizes}).orderBy("i").collect()
    return [(r["__typed__c"], r["__issue__c"]) for r in rows]


DECIMALS = {
    "1,234.56": "1234.56", "1.234,56": "1234.56", "12,34,567.8": "1234567.8", "1'234.5": "1234.5", "1 234,5": "1234.5", "1 234,5": "1234.5", "0,014": "0.014", "1,234": "1234", "12.345": "12345",
    "1234.567": "1234567", ".5": "0.5", "5.": "5", "-007.50": "-7.5", "0.00": "0", "1,2,3.45": None, "12,3456.7": None, "1.5e10": None, "abc": None, "0.0001": None,
}


def test_decimals(spark):
    got = convert(spark, DECIMALS, ColumnConfig("decimal"))
    for (cell, want), (value, issue) in zip(DECIMALS.items(), got):
        assert value == (Decimal(want) if want else None), cell
        assert (issue is None) == (want is not None), cell


def test_integers(spark):
    cells = {"1,234": 1234, "1.234": 1234, "12,34,567": 1234567, "+5": 5, "5.0": None, "99999999999999999999": None, " 7 ": 7}
    assert convert(spark, cells, ColumnConfig("integer")) == [(v, None if v is not None else "INVALID_INTEGER") for v in cells.values()]


@pytest.mark.parametrize(
    "kind, cr_negative, cells",
    [
        ("percentage", True, {"45%": "45", "1,5 %": "1.5", "12%%": None}),
        ("currency", True, {"$1,234.50": "1234.5", "NOK 13.444,33": "13444.33", "5 EUR": "5", "($5.00)": "-5", "17.30-": "-17.3", "-$5.00": "-5", "AU$ 7": "7"}),
        ("signed", True, {"5 CR": "-5", "DR 5": "5", "(5)": "-5", "5-": "-5", "+5": "5", "-5": "-5"}),
        ("signed", False, {"5 CR": "5", "DR 5": "-5"}),
        ("accounting", True, {"$5.00 CR": "-5", "USD 5 DR": "5", "($5)": "-5", "-$5": "-5", "5": "5"}),
    ],
)
def test_signs(spark, kind, cr_negative, cells):
    got = [v for v, _ in convert(spark, cells, ColumnConfig(kind, cr_negative=cr_negative))]
    assert got == [Decimal(v) if v else None for v in cells.values()]


def test_symbols(spark):
    source = money.around
    assert apply(spark, lambda c: money.currency_symbol(source(c)), ["5 AU$", "AU$ 5", "usd 5", "(€5)", "5", None]) == ["$", "AU$", "USD", "€", None, None]
    assert apply(spark, lambda c: money.symbol_position(source(c)), ["5 $", "$5", "5"]) == ["suffix", "prefix", None]
    assert apply(spark, lambda c: money.currency_symbol(source(c), True), ["CR $5", "5 usd dr", "($5)", "- $ 5", "dr (5 €) ", "$x", "x$", "$", "cr"]) == ["$", "USD", "$", "$", "€", "$", "$", None, None]
    assert apply(spark, lambda c: money.marker_of(source(c), "CR"), ["cr 5", "5 CR", "5", "cr", "$ 5 cr"]) == ["CR", "CR", None, None, "CR"]
    assert apply(spark, money.token_form, ["USD", "AU$", "€"]) == ["code", "composite", "symbol"]
    assert apply(spark, lambda c: money.sign_notation(source(c)), ["5 CR", "DR 5", "(5)", "-5", "5-", "5"]) == ["negative_marker", "positive_marker", "parentheses", "leading_sign", "trailing_sign", "unsigned"]


def test_dates(spark):
    cells = {"2023-01-03": (1, 3), "2023/1/3": (1, 3), "01/02/2023": (1, 2), "13/02/2023": None, "Jan 3, 2023": (1, 3), "2023-01-03 04:05:06": (1, 3), " 2023-01-03\t": (1, 3), "45000": (3, 15), "19999": None, "60000": None, "2023": None, "01/02/98": None, "2023-02-30": None, "2023-001-03": None, "3 Jan 2023": None, "Foo 3 2023": None}
    assert apply(spark, lambda c: temporal.to_date(c), cells) == [date(2023, *v) if v else None for v in cells.values()]
    day_first = ["01/02/2023", "13/02/2023", "3 jan 2023", "31.12.2022", "Jan 3, 2023"]
    assert apply(spark, lambda c: temporal.to_date(c, True), day_first) == [date(2023, 2, 1), date(2023, 2, 13), date(2023, 1, 3), date(2022, 12, 31), None]


def test_datetimes_and_times(spark):
    cells = ["01/02/2023 04:05", "2023-01-03T04:05:06", "2023-01-03", "45000.75", "2023-01-03T04:05:06Z", "2023-01-03 04:05:06.5"]
    assert apply(spark, lambda c: temporal.to_datetime(c), cells) == [datetime(2023, 1, 2, 4, 5), datetime(2023, 1, 3, 4, 5, 6), datetime(2023, 1, 3), datetime(2023, 3, 15, 18), None, None]
    assert apply(spark, temporal.to_time, ["04:05", "1:05 PM", "12:00 am", "13:05 PM", "24:00", "4:60", "x"]) == ["04:05:00", "13:05:00", "00:00:00", None, None, None, None]


def test_booleans_codes_and_strings(spark):
    pairs = list(zip(values.TRUE_WORDS, values.FALSE_WORDS))
    assert len(pairs) == 18
    assert apply(spark, values.to_boolean, [f" {w.upper()} " for p in pairs for w in p] + ["maybe"]) == [True, False] * 18 + [None]
    assert apply(spark, lambda c: values.to_code(c, ["US", "DE"]), [" us ", "USA"]) == ["US", None]
    assert len(values.iso_codes("country_alpha_2")) > 240 and "fra" in values.iso_codes("language_alpha_3")
    assert apply(spark, values.to_email, ["A.B@Example.COM", "a@b", "a@b.c\n"]) == ["a.b@example.com", None, None]
    assert apply(spark, values.to_url, ["https://a.b/c", "ftp://a.b", "http:// x"]) == ["https://a.b/c", None, None]
    assert apply(spark, values.to_ip, ["255.1.1.1", "256.1.1.1", "::1", "fe80::1:2", "1::2::3"]) == ["255.1.1.1", None, "::1", "fe80::1:2", None]
    assert apply(spark, lambda c: values.to_ip(c, "v4"), ["::1", "1.2.3.4"]) == [None, "1.2.3.4"]
    assert apply(spark, values.to_phone, ["+1 (415) 555-2671", "415-555-2671"]) == ["+14155552671", None]


def test_categories_are_kept_and_flagged(spark):
    got = convert(spark, [" shipped ", "unknown", None], ColumnConfig("categorical", canonical_values=("Shipped", "SHIPPED")))
    assert got == [("Shipped", None), ("unknown", "INVALID_CATEGORICAL"), (None, None)]


def test_null_notions(spark):
    cells = [None, "", " ", " ", "\t", " N/A ", "-", "x"]
    assert apply(spark, lambda c: text.nullish(c, ["n/a", "-"]), cells) == [True, True, True, True, False, True, True, False]
    assert apply(spark, text.blank_in_row, cells) == [True, True, True, False, True, False, False, False]


def test_decimal_sizes():
    assert numeric.decimal_type(2, 10) == (18, 2)
    assert numeric.decimal_type(4, 17) == (38, 4)
    assert numeric.decimal_type(20, 30) == (38, 8)


def test_most_surroundings_need_no_expression(spark):
    """A t that a source holds is no token; shapes and expressions agree; whole numbers beyond 64 bits are null."""
    cells = ["t5", "5t", "$5", "($ 5)", "5-", "-r$5", "5 cr", "5 usd"]
    assert apply(spark, money.accounting_candidate, cells) == ["t5", "5t", "5", "-5", "-5", "-5", "-5", "5"]
    assert "T#" in money._decided(money._around(*money._CURRENCY), "[(-]")[""]
    limits = ["9223372036854775807", "9223372036854775808", "-9223372036854775808", "-9223372036854775809", "0" * 50 + "5", "1" * 45]
    assert apply(spark, numeric.to_integer, limits) == [(1 << 63) - 1, None, -(1 << 63), None, 5, None]


def test_order_evidence_reads_one_cut(spark):
    """The cut is a column that both orders read; each had cuts of its own before."""
    from grainmill import queries

    days = spark.createDataFrame([(1, "13/01/2024"), (2, "01/13/2024"), (3, "2024-01-13"), (4, None)], "id int, day string")
    found = queries.ordered_by(days)
    assert [(r.day_first, r.month_first) for r in found.orderBy("id").collect()] == [(True, False), (False, True), (False, False), (False, False)]
    assert found._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 1


def test_trimming_and_blanks(spark):
    """Separators of one byte and of several, at either end and alone; characters taken out one by one."""
    cells = ["  a b ", " a　", "  é ", "\tx", " ", "", " ", None]
    assert apply(spark, text.trim, cells) == ["a b", "a", "é", "\tx", "", "", "", None]
    assert apply(spark, text.blank_in_row, [" \t\r\n", "", None, " ", " x "]) == [True, True, True, False, False]
    assert apply(spark, lambda c: text.without(c, ",. "), ["1,2.3 4", "", None]) == ["1234", "", None]
