"""The registered queries: every operator over messy tables derived from the driver's data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import raw
from .config import ColumnConfig, Options, SourceFormat
from .functions import money, numeric, temporal, values
from .functions.text import nullish
from .operators import convert, increments, infer, issues, profile, quality, rows, sample, trace
from .operators.cells import staged
from .scratch import scratch_path
from .scratch import table as scratch_table
from .session import configure
from .sources import layout as layouts
from .sources import log, readers, sinks, store
from .streaming import convert as stream
from .streaming import publish as streams

TOKENS = ("n/a", "-", "none", "null")
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(table: str):
    """Registers a query over one raw table; its session gets the settings first."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(raw.load(configure(spark), folder, table))

        run.__name__ = f.__name__
        _QUERIES[f.__name__] = run
        return f

    return add


def _typed(df: DataFrame, column: str, config: ColumnConfig, sizes=(18, 2), text: str | None = None) -> DataFrame:
    """id, the typed value and the issue of one column."""
    found = convert.convert_cells(df.select("id", column), {column: config}, TOKENS, {column: sizes})
    value = F.col(f"__typed__{column}")
    return found.select("id", (value.cast(text) if text else value).alias("value"), F.col(f"__issue__{column}").alias("issue"))


def _counts(df: DataFrame, columns: dict[str, ColumnConfig]) -> DataFrame:
    return profile.profile_counts(df, columns, TOKENS)


# Rows and nulls

@_query("sparse")
def column_counts(df):
    return rows.column_counts(df.select("a", "b", "c"), TOKENS)


@_query("sparse")
def nullish_flags(df):
    return df.select("id", *(nullish(F.col(c), TOKENS).alias(c) for c in ("a", "b", "c")))


@_query("sparse")
def empty_row_filter(df):
    return rows.drop_empty_rows(df, ["a", "b", "c"])


@_query("sparse")
def row_index_after_filter(df):
    return rows.with_row_index(rows.drop_empty_rows(df, ["a", "b", "c"]), "row_index", ["id"]).select("id", "row_index")


# Texts and keys

@_query("people")
def string_profile(df):
    columns = {"name": ColumnConfig(), "segment": ColumnConfig(), "flag": ColumnConfig()}
    distinct = profile.distinct_counts(df, list(columns), TOKENS).select("column_name", F.lit("distinct_count").alias("metric"), F.col("distinct_count").alias("value"))
    return _counts(df, columns).union(distinct)


@_query("people")
def identifier_profile(df):
    columns = {"account": ColumnConfig("identifier", identifier_kind="primary"), "nation": ColumnConfig("identifier", identifier_kind="foreign")}
    distinct = profile.distinct_counts(df, list(columns), TOKENS).select("column_name", F.lit("distinct_count").alias("metric"), F.col("distinct_count").alias("value"))
    return _counts(df, columns).union(distinct)


@_query("people")
def identifier_duplicates(df):
    return profile.duplicates(df, "nation", TOKENS)


@_query("people")
def approximate_distinct(df):
    return profile.distinct_counts(df, ["name", "nation", "segment"], TOKENS, approximate=True)


# Booleans, codes, categories, structured strings

@_query("people")
def boolean_convert(df):
    return _typed(df, "flag", ColumnConfig("boolean"))


@_query("people")
def boolean_profile(df):
    return _counts(df, {"flag": ColumnConfig("boolean")})


@_query("people")
def country_code_validity(df):
    return _typed(df, "code", ColumnConfig("country_code")).drop("issue")


@_query("people")
def currency_code_validity(df):
    return _typed(df, "currency", ColumnConfig("currency_code")).drop("issue")


@_query("people")
def language_code_validity(df):
    return _typed(df, "language", ColumnConfig("language_code")).drop("issue")


@_query("people")
def code_profile(df):
    return _counts(df, {"code": ColumnConfig("country_code"), "language": ColumnConfig("language_code")})


@_query("people")
def categorical_convert(df):
    return _typed(df, "segment", ColumnConfig("categorical", canonical_values=SEGMENTS))


@_query("people")
def categorical_profile(df):
    return _counts(df, {"segment": ColumnConfig("categorical", canonical_values=SEGMENTS)})


@_query("people")
def email_convert(df):
    return _typed(df, "email", ColumnConfig("email"))


@_query("people")
def ip_convert(df):
    return _typed(df, "ip", ColumnConfig("ip_address"))


@_query("people")
def ip_v4_convert(df):
    return _typed(df, "ip", ColumnConfig("ip_address", version="v4"))


@_query("people")
def phone_convert(df):
    return _typed(df, "phone", ColumnConfig("phone"))


@_query("people")
def structured_profile(df):
    return _counts(df, {"email": ColumnConfig("email"), "ip": ColumnConfig("ip_address"), "phone": ColumnConfig("phone")})


def url_convert(spark: SparkSession, folder: str) -> DataFrame:
    pages = configure(spark).read.parquet(f"{folder}/pages.parquet")
    url = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("ftp://"), F.col("url"))).otherwise(F.concat(F.lit(" "), F.col("url")))
    return _typed(pages.select(F.col("page_id").alias("id"), url.alias("url")), "url", ColumnConfig("url"))


_QUERIES["url_convert"] = url_convert


# Numbers

@_query("money")
def integer_convert(df):
    return _typed(df, "whole", ColumnConfig("integer"))


@_query("money")
def integer_profile(df):
    return _counts(df, {"whole": ColumnConfig("integer")})


@_query("money")
def decimal_separator(df):
    clean = numeric.strip_groups(F.trim("number"))
    return df.select("id", F.when(numeric.is_decimal(clean), numeric.decimal_separator(clean)).alias("separator"))


@_query("money")
def decimal_convert(df):
    return _typed(df, "number", ColumnConfig("decimal"), (18, 3))


@_query("money")
def decimal_profile(df):
    return _counts(df, {"number": ColumnConfig("decimal"), "percent": ColumnConfig("percentage")})


@_query("money")
def percentage_convert(df):
    return _typed(df, "percent", ColumnConfig("percentage"))


@_query("money")
def currency_convert(df):
    return _typed(df, "amount", ColumnConfig("currency"))


@_query("money")
def currency_profile(df):
    return _counts(df, {"amount": ColumnConfig("currency")})


@_query("money")
def signed_convert(df):
    return _typed(df, "signed", ColumnConfig("signed"))


@_query("money")
def signed_convert_dr(df):
    return _typed(df, "signed", ColumnConfig("signed", cr_negative=False))


@_query("money")
def accounting_convert(df):
    return _typed(df, "amount", ColumnConfig("accounting"))


@_query("money")
def accounting_convert_dr(df):
    return _typed(df, "amount", ColumnConfig("accounting", cr_negative=False))


@_query("money")
def currency_symbols(df):
    return profile.symbol_metrics(df, {"amount": ColumnConfig("currency")}, TOKENS)


@_query("money")
def accounting_symbols(df):
    return profile.symbol_metrics(df, {"amount": ColumnConfig("accounting")}, TOKENS)


@_query("money")
def dominant_value(df):
    return profile.dominant(profile.symbol_metrics(df, {"amount": ColumnConfig("accounting")}, TOKENS))


@_query("money")
def token_forms(df):
    symbols = profile.symbol_metrics(df, {"amount": ColumnConfig("currency")}).where("metric_name = 'symbol'")
    return symbols.select(F.col("metric_value").alias("symbol"), F.col("count").alias("n"), money.token_form(F.col("metric_value")).alias("form"))


# Times

@_query("times")
def date_convert_day_first(df):
    return _typed(df, "day", ColumnConfig("date", day_first=True))


@_query("times")
def date_convert_month_first(df):
    return _typed(df, "day", ColumnConfig("date"))


def ordered_by(df: DataFrame) -> DataFrame:
    """Whether each day reads in either order; both readings share one cut."""
    cut, levels = temporal.stages(F.col("day"), "day")
    read = staged(df.select("id", "day"), [levels])
    return read.select("id", *(F.coalesce(temporal.date_order_of(cut, order), F.lit(False)).alias(c) for c, order in (("day_first", True), ("month_first", False))))


@_query("times")
def date_order_evidence(df):
    return ordered_by(df)


@_query("times")
def date_profile(df):
    return _counts(df, {"day": ColumnConfig("date", day_first=True)})


@_query("times")
def datetime_convert_day_first(df):
    return _typed(df, "moment", ColumnConfig("datetime", day_first=True))


@_query("times")
def datetime_convert_month_first(df):
    return _typed(df, "moment", ColumnConfig("datetime"))


@_query("times")
def datetime_profile(df):
    return _counts(df, {"moment": ColumnConfig("datetime")})


@_query("times")
def time_convert(df):
    return _typed(df, "clock", ColumnConfig("time"))


@_query("times")
def time_profile(df):
    return _counts(df, {"clock": ColumnConfig("time")})


# Whole tables

MONEY_COLUMNS = {"amount": ColumnConfig("accounting"), "percent": ColumnConfig("percentage"), "whole": ColumnConfig("integer")}
#: Rows of a bucket of published tables, some hundred MB.
BUCKET_ROWS = 2_000_000
_ALL = Options(null_tokens=TOKENS, trace_mode=("full",), full_raw_row=True)


def _converted(df: DataFrame, numbered: bool = True) -> DataFrame:
    # Rows that are alike in all these may take each other's numbers.
    return convert.convert(df.select("id", *MONEY_COLUMNS), MONEY_COLUMNS, _ALL, order_by=("id", *MONEY_COLUMNS), keep_raw=True, numbered=numbered)


@_query("money")
def converted_table(df):
    return convert.export(_converted(df), MONEY_COLUMNS, _ALL)


@_query("money")
def row_errors(df):
    return _converted(df).select("_row_index", "_parse_error_count")


@_query("money")
def trace_issues(df):
    return trace.trace(_converted(df), MONEY_COLUMNS, ("issues",))


@_query("money")
def trace_changes(df):
    return trace.trace(_converted(df), MONEY_COLUMNS, ("changes",))


@_query("money")
def trace_full(df):
    return trace.trace(_converted(df), MONEY_COLUMNS, ("full",))


@_query("money")
def column_quality(df):
    return quality.column_quality(_converted(df, numbered=False), list(MONEY_COLUMNS))


@_query("money")
def quality_metrics(df):
    return quality.quality(_converted(df, numbered=False), list(MONEY_COLUMNS))


@_query("people")
def categorical_quality(df):
    columns = {"segment": ColumnConfig("categorical", canonical_values=SEGMENTS)}
    return quality.column_quality(convert.convert(df.select("id", "segment"), columns, Options(null_tokens=TOKENS), keep_raw=True, numbered=False), ["segment"])


@_query("money")
def verdict(df):
    found = quality.quality(_converted(df), list(MONEY_COLUMNS))
    return found.select(quality.verdict_column(F.col("quality_score"), F.col("worst_column_score"), F.lit(0), F.lit(1)).alias("verdict"))


@_query("people")
def type_evidence(df):
    return infer.evidence(df.drop("id"), TOKENS)


@_query("people")
def language_alpha_3_validity(df):
    """Codes of languages with and without a two-letter code, and one that is none."""
    made = F.element_at(F.array(*map(F.lit, ("fra", " DEU ", "haw", "yue", "zzz", "en"))), (F.col("id") % 6 + 1).cast("int"))
    return _typed(df.select("id", made.alias("language")), "language", ColumnConfig("language_code", code_format="alpha_3")).drop("issue")


@_query("people")
def approximate_distinct_bound(df):
    """Whether the sketch is within a tenth of the exact count."""
    names = ["name", "nation", "segment"]
    exact, near = profile.distinct_counts(df, names, TOKENS), profile.distinct_counts(df, names, TOKENS, approximate=True).withColumnRenamed("distinct_count", "near")
    return exact.join(near, "column_name").select("column_name", "distinct_count", (F.abs(F.col("near") - F.col("distinct_count")) <= 0.1 * F.col("distinct_count")).alias("within"))


@_query("money")
def trace_joined(df):
    """What the trace is for: the issues beside the converted rows they stand in."""
    made = _converted(df)
    table = convert.export(made, MONEY_COLUMNS, _ALL).select("_row_index", "amount", "percent", "whole")
    return trace.trace(made, MONEY_COLUMNS, ("issues",)).join(table, F.col("row_index") == F.col("_row_index")).drop("_row_index")


# Sources and artifacts: written, then read as a user's files are

_PEOPLE = ("id", "account", "name", "segment", "flag", "email", "phone")


def _as_read(df: DataFrame) -> DataFrame:
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns))


@_query("people")
def csv_source(df):
    """A CSV file with its layout found out and read back, split over tasks."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "csv")
    texts = df.select(*(F.col(c).cast("string").alias(c) for c in _PEOPLE))
    texts.coalesce(1).write.option("header", True).option("sep", ";").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    (file,) = store.files(spark, path, ".csv")
    return _as_read(readers.read_source(spark, file, layouts.csv_layout(store.prefix(spark, file))))


@_query("people")
def csv_source_of_many_lines(df):
    """Cells that hold quotes, separators and line ends."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "csv")
    texts = df.select(F.col("id").cast("string").alias("id"), F.concat(F.col("name"), F.lit('\nsaid, "'), F.col("account"), F.lit('"')).alias("said"))
    texts.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    (file,) = store.files(spark, path, ".csv")
    return readers.read_source(spark, file, SourceFormat())


@_query("people")
def csv_source_below_a_preamble(df):
    """Two lines above the header, and cells with line ends and quotes."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "csv")
    said = F.concat(F.lit('"'), F.col("name"), F.lit('\né ""'), F.col("account"), F.lit('"""'))
    line = F.concat_ws("|", F.col("id").cast("string"), said)
    first = df.agg(F.min("id")).first()[0]
    lines = df.select("id", F.when(F.col("id") == first, F.concat(F.lit("Clientèle\n\nid|said\n"), line)).otherwise(line).alias("value"))
    lines.repartition(1).sortWithinPartitions("id").select("value").write.text(path)
    (file,) = store.files(spark, path, ".txt")
    return readers.read_source(spark, file, SourceFormat(header_row=3, delimiter="|"))


@_query("people")
def json_source(df):
    """One array of all customers, written by a task and read in ranges; numbers keep their text."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "json")
    shown = df.select("id", (F.col("id") / 4).alias("rate"), *_PEOPLE[1:])
    text = F.to_json(F.struct(*shown.columns), {"ignoreNullFields": "false"})
    ends = shown.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
    line = F.concat(F.when(F.col("id") == ends.low, "[").otherwise(""), text, F.when(F.col("id") == ends.high, "]").otherwise(","))
    shown.repartition(1).sortWithinPartitions("id").select(line.alias("value")).write.text(path)
    (file,) = store.files(spark, path, ".txt")
    store.move(spark, file, f"{path}.json")
    return _as_read(readers.read_source(spark, f"{path}.json", SourceFormat("json")))


def _write_workbooks(df: DataFrame, folder: str) -> None:
    """A workbook of up to some 100,000 rows for each key of the column ``book``, written by its task."""

    def write(group: pd.DataFrame) -> pd.DataFrame:
        files, top = pafs.FileSystem.from_uri(folder)
        rows = group.sort_values("id")[["id", "name", "half"]].itertuples(index=False)
        data = readers.workbook_bytes("Data", [["Customers"], ["Key", "Name", "Half"], *([str(i), n, float(h)] for i, n, h in rows)])
        # Named anew in each attempt; a folder's listing after the job has the one that the job names.
        name = f"{group['book'].iloc[0]}-{uuid.uuid4().hex}.xlsx"
        with files.open_output_stream(f"{top}/{name}") as out:
            out.write(data)
        return pd.DataFrame({"name": [name]})

    spark = df.sparkSession
    store.write_text(spark, f"{folder}/parts/.keep", "")
    made = [r.name for r in df.groupBy("book").applyInPandas(write, "name string").collect()]
    for name in made:
        store.move(spark, f"{folder}/{name}", f"{folder}/parts/{name}")


@_query("people")
def excel_source(df):
    """Workbooks with a title above the header, written and read by tasks."""
    spark, folder = df.sparkSession, scratch_path(df.sparkSession, "excel")
    books = max(4, df.count() // 100_000)
    _write_workbooks(df.select("id", "name", (F.col("id") / 2).alias("half"), F.pmod("id", F.lit(books)).alias("book")), folder)
    return readers.read_source(spark, f"{folder}/parts", SourceFormat("excel", header_row=2))


@_query("money")
def published_table(df):
    """The table as it is found through the manifest after publication."""
    return df.sparkSession.read.parquet(_published(df)["converted"])


@_query("money")
def published_trace(df):
    return df.sparkSession.read.parquet(_published(df)["trace"])


@_query("money")
def published_trace_joined(df):
    """Trace and table as published in buckets: their join needs no shuffle."""
    found = sinks.tables(df.sparkSession, _published_in(df, bucket_rows=BUCKET_ROWS))
    return found["trace"].join(found["converted"].select("_row_index", "amount", "percent", "whole"), F.col("row_index") == F.col("_row_index")).drop("_row_index")


@_query("money")
def trace_of_variants(df):
    """The whole trace from the published table alone."""
    return trace.trace_of_published(sinks.tables(df.sparkSession, _published_in(df, variants=True))["converted"], MONEY_COLUMNS, ("full",))


@_query("money")
def issues_by_path(df):
    """Wrong cells of one column by what they begin with, read by path from the variants."""
    found = sinks.tables(df.sparkSession, _published_in(df, variants=True))["converted"]
    raw = F.variant_get("_parse_issues_variant", "$.amount.raw", "string")
    return found.where(raw.isNotNull()).groupBy(F.left(raw, F.lit(1)).alias("first"), F.variant_get("_parse_issues_variant", "$.amount.code", "string").alias("code")).agg(F.count("*").alias("n"))


def _published(df: DataFrame) -> dict[str, str]:
    return sinks.artifacts(df.sparkSession, _published_in(df))


def _published_in(df: DataFrame, bucket_rows: int | None = None, variants: bool = False) -> str:
    """The folder in which the table and its trace of issues are published, in eight buckets or more of ``bucket_rows`` rows, if that is given."""
    options = Options(null_tokens=TOKENS, trace_mode=("issues",), full_raw_row=True, variants=variants)
    made, folder = scratch_table(_converted(df), "converted"), scratch_path(df.sparkSession, "published")
    found = quality.quality(made, list(MONEY_COLUMNS)).first().asDict()
    buckets = max(8, -(-found["row_count"] // bucket_rows)) if bucket_rows else None
    sinks.publish(made, MONEY_COLUMNS, options, folder, found, [], buckets=buckets)
    return folder


# Types and issues

@_query("money")
def money_types(df):
    return _types(df)


@_query("people")
def people_types(df):
    return _types(df)


def time_types(spark: SparkSession, folder: str) -> DataFrame:
    """Dates and datetimes of one order each, with some cells that are none."""
    at = configure(spark).read.parquet(f"{folder}/lineitem.parquet").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("t"))
    shown = lambda form: F.when(F.col("id") % 11 == 0, "n/a").when(F.col("id") % 5 == 0, "soon").otherwise(F.date_format("t", form))
    forms = {"iso": "yyyy-MM-dd", "day_month": "dd/MM/yyyy", "month_day": "MM-dd-yyyy", "named": "dd MMM yyyy", "moment": "yyyy-MM-dd HH:mm", "moment_day": "dd/MM/yyyy HH:mm:ss", "clock": "HH:mm", "half": "hh:mm a"}
    return _types(at.select("id", *(shown(f).alias(c) for c, f in forms.items())))


_QUERIES["time_types"] = time_types


def key_types(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of every kind, and codes."""
    key = F.col("c_custkey").cast("string")
    among = lambda *words: F.element_at(F.array(*map(F.lit, words)), (F.col("c_custkey") % len(words) + 1).cast("int"))
    columns = {
        "id": key, "nation_id": F.col("c_nationkey").cast("string"), "account_id": F.concat(F.lit("a"), key), "SKU": F.concat(F.lit("SKU-"), key), "external identifier": F.concat(F.lit("x"), key),
        "number": F.when(F.col("c_custkey") % 8 == 0, "7").otherwise(key), "country": among("US", "de", "FR", "GB"), "money": among("usd", "EUR", "JPY"), "speech": among("en", "DE", "fr", "es"), "land": among("USA", "DEU", "n/a"), "mixed": among("US", "de", "nowhere"),
    }
    df = configure(spark).read.parquet(f"{folder}/customer.parquet")
    return _types(df.select("c_custkey", *(c.alias(n) for n, c in columns.items())).withColumnRenamed("c_custkey", "id_"), "id_")


_QUERIES["key_types"] = key_types


def _types(df: DataFrame, drop: str = "id") -> DataFrame:
    """The types that the rules decide on all rows."""
    found = infer.infer_types(df.drop(drop), TOKENS, codes=True)
    return df.sparkSession.createDataFrame([(c, t.type, t.day_first, t.identifier_kind if t.type == "identifier" else None) for c, t in found.items()], "column_name string, type string, day_first boolean, kind string")


@_query("sparse")
def null_tokens_found(df):
    return df.sparkSession.createDataFrame([(t,) for t in infer.infer_null_tokens(df.drop("id"))], "token string")


@_query("money")
def money_issues(df):
    return _issues(df, {"amount": ColumnConfig("accounting"), "number": ColumnConfig("decimal"), "percent": ColumnConfig("percentage")})


@_query("people")
def people_issues(df):
    columns = {"account": ColumnConfig("identifier", identifier_kind="primary"), "nation": ColumnConfig("identifier", identifier_kind="foreign"), "segment": ColumnConfig("identifier", identifier_kind="primary")}
    return _issues(df, columns, SourceFormat(header_row=3))


@_query("times")
def time_issues(df):
    """A column of dates of which some tell the order, and one of which none does."""
    columns = {"day": ColumnConfig("date"), "low": ColumnConfig("date", day_first=True)}
    return _issues(df.withColumn("low", F.when(F.col("id") % 3 == 0, "n/a").otherwise(F.concat(F.lit("0"), F.col("id") % 9 + 1, F.lit("/05/2024")))), columns)


def low_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Columns whose most frequent value stands for a confidence below the threshold."""
    df = configure(spark).read.parquet(f"{folder}/customer.parquet")
    shares = {r.c: r.share for r in df.agg((F.count_if(F.col("c_nationkey") < 12) / F.count("*")).alias("c_nationkey"), (F.count_if(F.length("c_mktsegment") > 3) / F.count("*")).alias("c_mktsegment")).select(F.inline(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("share")) for c in ("c_nationkey", "c_mktsegment"))))).collect()}
    found = issues.confidence_issue(shares)
    return spark.createDataFrame([(i.code, i.severity, c, float(v)) for i in found for c, v in i.evidence["items"].items()], "code string, severity string, column_name string, confidence double")


_QUERIES["low_confidence"] = low_confidence


def _issues(df: DataFrame, columns: dict[str, ColumnConfig], source: SourceFormat | None = None) -> DataFrame:
    found = profile.profile(df, columns, TOKENS)
    listed = issues.dataset_issues(columns, source) + [i for c, config in columns.items() for i in issues.column_issues(c, config, found[c])]
    return df.sparkSession.createDataFrame([(i.code, i.severity, i.column) for i in listed], "code string, severity string, column_name string")


def streamed_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The conversion of the events' texts as a stream over the table's file, written to the shared folder and read again."""
    configure(spark)
    path = scratch_path(spark, "stream")
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, F.lit("abc")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("value"), F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("user"))
    made = stream.convert_stream(events, {"value": ColumnConfig("decimal"), "user": ColumnConfig("integer")}, TOKENS, {"value": (18, 2)})
    query = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


_QUERIES["streamed_rows"] = streamed_rows


def _event_stream(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """The events as texts, written in four files and read as a stream of a batch each."""
    shown = {"id": F.col("event_id"), "at": F.col("ts"), "value": F.when(F.col("event_id") % 7 == 0, F.lit("abc")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")), "user": F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string"))}
    events = configure(spark).read.parquet(f"{folder}/events.parquet").select(*(c.alias(n) for n, c in shown.items()))
    events.repartition(4, "id").write.parquet(f"{path}/in")
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


_EVENT_COLUMNS = {"value": ColumnConfig("decimal"), "user": ColumnConfig("integer")}


def _published_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Published in batches; every batch but the first is put by a query that goes on from the checkpoint."""
    path = scratch_path(spark, "stream")
    raw_events = _event_stream(spark, folder, path)
    for trigger in ({"once": True}, {"availableNow": True}):
        streams.publish_stream(raw_events, _EVENT_COLUMNS, f"{path}/out", f"{path}/state", TOKENS, {"value": (18, 2)}, trigger=trigger).awaitTermination()
    return log.read(spark, f"{path}/out")


def published_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _published_stream(spark, folder).select("id", "value", "user", "_parse_error_count")


def streamed_row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """The row numbers that go on from batch to batch."""
    return _published_stream(spark, folder).select("_row_index")


def streamed_issue_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and errors by hour, kept up to date by batches that hold events of all hours."""
    path = scratch_path(spark, "stream")
    made = stream.convert_stream(_event_stream(spark, folder, path), _EVENT_COLUMNS, TOKENS, {"value": (18, 2)})
    streams.publish_issue_counts(made, "at", f"{path}/out", f"{path}/state", late="60 days").awaitTermination()
    return streams.issue_counts_of(spark, f"{path}/out")


_QUERIES |= {f.__name__: f for f in (published_stream, streamed_row_numbers, streamed_issue_counts)}


# Samples and profiles of parts

@_query("sparse")
def first_values(df):
    """The first ten values of each column, of which each part of the source holds some."""
    at = df.repartitionByRange("id").sortWithinPartitions("id")
    placed = scratch_table(at.select("a", "b", "c", F.col("id").cast("string").alias("key"), F.monotonically_increasing_id().alias("place")), "placed")
    return sample.first_values(placed, 10, "place", ("none",))


_PART_COLUMNS = {"number": ColumnConfig("decimal"), "percent": ColumnConfig("percentage")}


def _merged(df: DataFrame, columns: dict[str, ColumnConfig]) -> DataFrame:
    """The states of four parts, kept in a folder and merged."""
    folder = scratch_path(df.sparkSession, "states")
    for i in range(4):
        increments.add_part(df.where(F.pmod(F.hash("id"), F.lit(4)) == i), columns, folder, f"part-{i}", TOKENS)
    return increments.merge(log.read(df.sparkSession, folder))


@_query("money")
def merged_profile(df):
    return _merged(df, _PART_COLUMNS).where("metric_value is null").select("column_name", "metric", "value")


@_query("money")
def merged_symbols(df):
    return _merged(df, {"amount": ColumnConfig("accounting")}).where("metric_value is not null").select("column_name", F.col("metric").alias("metric_name"), "metric_value", F.col("value").alias("count"))


@_query("people")
def merged_distinct_bound(df):
    """Whether the merged sketches are within a twentieth of the exact counts."""
    names = ["name", "nation", "segment"]
    near = _merged(df, dict.fromkeys(names, ColumnConfig("string"))).where(F.col("metric") == increments.DISTINCT).select("column_name", F.hll_sketch_estimate("sketch").alias("near"))
    exact = profile.distinct_counts(df, names, TOKENS)
    return exact.join(near, "column_name").select("column_name", "distinct_count", (F.abs(F.col("near") - F.col("distinct_count")) <= 0.05 * F.col("distinct_count")).alias("within"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def entry(spark: SparkSession, folder: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship: accounting amounts, percentages and counts typed, indexed and audited."""
    return _QUERIES["converted_table"](spark, folder)
