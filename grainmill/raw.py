"""Messy text tables derived from the driver's tables, as SQL that Spark and DuckDB read alike.

Numbers go through DECIMAL before they become text, as the engines write doubles differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DAYS = {"spark": "CAST(datediff(CAST({c} AS DATE), DATE '1899-12-30') AS STRING)", "duckdb": "CAST(datediff('day', DATE '1899-12-30', CAST({c} AS DATE)) AS STRING)"}
_TWO = "lpad(CAST({x} AS STRING), 2, '0')"


def _ymd(c: str, s: str) -> str:
    return f"concat(CAST(year({c}) AS STRING), '{s}', {_TWO.format(x=f'month({c})')}, '{s}', {_TWO.format(x=f'day({c})')})"


def _dmy(c: str, s: str, first: str = "day", second: str = "month") -> str:
    return f"concat({_TWO.format(x=f'{first}({c})')}, '{s}', {_TWO.format(x=f'{second}({c})')}, '{s}', CAST(year({c}) AS STRING))"


def _mon(c: str) -> str:
    return f"substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(month({c}) * 3 - 2 AS INT), 3)"


def _cases(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def money(engine: str) -> str:
    """id, amount, signed, percent, number and whole from lineitem."""
    p = "CAST(CAST({c} AS DECIMAL(18,2)) AS STRING)"
    base = f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey + l_linenumber AS k, {p.format(c='l_extendedprice')} AS p, {p.format(c='l_discount * 100')} AS q, CAST(l_quantity AS BIGINT) AS n FROM lineitem"
    cut = "SELECT *, CAST(split_part(p, '.', 1) AS BIGINT) AS i, split_part(p, '.', 2) AS f FROM b"
    head, rest = "CAST(CAST((i - i % 1000) / 1000 AS BIGINT) AS STRING)", "lpad(CAST(i % 1000 AS STRING), 3, '0')"
    group = lambda s, d: f"CASE WHEN i >= 1000 THEN concat({head}, '{s}', {rest}, '{d}', f) ELSE concat(CAST(i AS STRING), '{d}', f) END"
    shaped = f"SELECT id, k, p, q, n, {group(',', '.')} AS w, {group('.', ',')} AS e FROM c"
    amount = _cases("k", "concat('$', w)", "concat('USD ', w)", "concat(w, ' USD')", "concat('$ ', w)", "concat('($', w, ')')", "concat(w, '-')", "concat(w, ' CR')", "concat(w, ' DR')", "p", "concat('€', e)", "concat('-$', w)", "concat('AU$ ', w)", "concat(w, ' AU$')", "'abc'", "'n/a'", "NULL", "concat('  NOK ', e, ' ')")
    signed = _cases("k", "w", "concat('(', w, ')')", "concat(w, '-')", "concat('-', w)", "concat(w, ' CR')", "concat('DR ', w)", "concat('+', w)", "''", "'1,2,3.45'", "e")
    percent = _cases("k", "concat(q, '%')", "concat(replace(q, '.', ','), ' %')", "q", "'n/a'", "'12%%'")
    number = _cases("k", "w", "e", "p", "'0,014'", "'12.345'", "'.5'", "'1234.567'", "'1.5e10'", "'12,34,567.8'", "'abc'", "NULL", "'-'")
    whole = _cases("k", "CAST(n AS STRING)", "concat(CAST(n AS STRING), ',000')", "concat(CAST(n AS STRING), '.000')", "concat('+', CAST(n AS STRING))", "'5.0'", "'99999999999999999999'", "' 7 '", "'n/a'")
    return f"WITH b AS ({base}), c AS ({cut}), d AS ({shaped}) SELECT id, {amount} AS amount, {signed} AS signed, {percent} AS percent, {number} AS number, {whole} AS whole FROM d"


def times(engine: str) -> str:
    """id, day (dates in many shapes), moment (datetimes) and clock from lineitem."""
    c = "l_shipdate"
    day = _cases("k", _ymd(c, "-"), _ymd(c, "/"), _dmy(c, "/"), _dmy(c, "/", "month", "day"), _dmy(c, "."), f"concat(CAST(day({c}) AS STRING), ' ', {_mon(c)}, ' ', CAST(year({c}) AS STRING))", f"concat({_mon(c)}, ' ', CAST(day({c}) AS STRING), ', ', CAST(year({c}) AS STRING))", _DAYS[engine].format(c=c), f"concat({_ymd(c, '-')}, ' 04:05:06')", "'no date'", "'n/a'", "'2023-02-30'", f"concat(' ', {_ymd(c, '-')}, ' ')", "NULL", "'01/02/98'", "'19999'", "'2023-001-03'")
    clock = "concat({}, ':', {})".format(_TWO.format(x="h"), _TWO.format(x="s"))
    moment = _cases("k", f"concat({_ymd(c, '-')}, ' ', {clock}, ':07')", f"concat({_ymd(c, '-')}, 'T', {clock})", f"concat({_dmy(c, '/')}, ' ', {clock})", f"concat({_dmy(c, '/', 'month', 'day')}, ' ', {clock}, ':59')", _ymd(c, "-"), f"concat({_DAYS[engine].format(c=c)}, '.75')", f"concat({_ymd(c, '-')}, 'T04:05:06Z')", "'never'", "''")
    hours = _cases("k", f"{clock}", f"concat({clock}, ':30')", f"concat({clock}, ' PM')", "'13:05 PM'", "'24:00'", "'1:05 AM'", "'?'")
    base = f"SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey + l_linenumber AS k, l_shipdate, l_orderkey % 12 + 1 AS h, l_linenumber * 7 % 60 AS s FROM lineitem"
    return f"WITH b AS ({base}) SELECT id, {day} AS day, {moment} AS moment, {hours} AS clock FROM b"


def people(engine: str) -> str:
    """id and texts of customers: name, segment with noise, flag, email, ip, phone, code and language."""
    key = "CAST(c_custkey AS STRING)"
    segment = _cases("c_custkey", "c_mktsegment", "lower(c_mktsegment)", "concat(' ', c_mktsegment, ' ')", "'unknown'", "'n/a'")
    flag = _cases("c_custkey", "'Yes'", "'no'", "' TRUE '", "'0'", "'oui'", "'maybe'", "NULL", "'-'")
    email = _cases("c_custkey", f"concat('User', {key}, '@Example.com')", f"concat('a.b+', {key}, '@mail.example.org')", f"concat('user', {key}, '@nowhere')", "'n/a'")
    ip = _cases("c_custkey", "concat('10.0.', CAST(c_custkey % 256 AS STRING), '.7')", "'256.1.1.1'", "'::1'", "concat('fe80::', CAST(c_custkey % 100 AS STRING))", "'1.2.3'", "''")
    phone = _cases("c_custkey", f"concat('+1 (415) 555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))", "'+49.30.1234567'", "'555-1234'", "NULL")
    code = _cases("c_custkey", "'us'", "' DE '", "'FR'", "'XX'", "'USA'", "'n/a'")
    language = _cases("c_custkey", "'EN'", "'de'", "'zz'", "' fr '", "''")
    currency = _cases("c_custkey", "'usd'", "'EUR'", "'AAA'", "NULL")
    return f"SELECT c_custkey AS id, {key} AS account, c_name AS name, CAST(c_nationkey AS STRING) AS nation, {segment} AS segment, {flag} AS flag, {email} AS email, {ip} AS ip, {phone} AS phone, {code} AS code, {language} AS language, {currency} AS currency FROM customer"


def sparse(engine: str) -> str:
    """id and cells that are often empty, from orders."""
    a = _cases("o_orderkey", "''", "'  '", "NULL", "'n/a'", "'x'", "'-'", "''")
    b = _cases("o_orderkey", "NULL", "' '", "''", "'NULL'", "'7'", "''", "''")
    c = _cases("o_custkey", "''", "'none'", "NULL", "' y '")
    return f"SELECT o_orderkey AS id, {a} AS a, {b} AS b, {c} AS c FROM orders"


_TABLES = {"money": ("lineitem", money), "times": ("lineitem", times), "people": ("customer", people), "sparse": ("orders", sparse)}


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    table, made = _TABLES[name]
    return spark.sql(made("spark").replace(f"FROM {table}", "FROM {source}"), source=spark.read.parquet(f"{folder}/{table}.parquet"))


def duckdb(name: str) -> str:
    return f"({_TABLES[name][1]('duckdb')})"
