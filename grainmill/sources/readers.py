"""CSV, JSON and spreadsheet readers."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SourceError, SourceFormat
from ..functions.text import count_char
from ..operators.headers import csv_names
from . import layout as layouts
from . import splits, store

_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"}
_RAGGED, _PLACE = "__ragged", "__source_place"


def read_source(spark: SparkSession, path: str, layout: SourceFormat, place: str | None = None) -> DataFrame:
    """The whole source as strings.  ``place`` names a column that rises in the order of the source; its bits beyond the lowest 33 number what is read together."""
    return {"csv": read_csv, "json": read_json, "excel": read_excel}[layout.kind](spark, path, layout, place=place)


def read_csv(spark: SparkSession, path: str, layout: SourceFormat, check: bool = True, place: str | None = None) -> DataFrame:
    """Columns are named by the header row, or column0, column1, ... without one.

    A file is split over tasks.  Where a cell holds a line end, or rows stand before the header, the tasks learn from a scan
    of all ranges which of their lines begin a record; else each line is one.  UTF-16 alone is read in one task a file.
    With ``check`` a row wider or narrower than the header raises SourceError; that costs one scan of the source.
    ``place`` names a column that rises in the order of the source.
    """
    text = store.prefix(spark, path).decode(layout.encoding, errors="ignore")
    skipped = layout.header_row or 0
    head = next(islice(csv.reader(io.StringIO(text, newline=""), delimiter=layout.delimiter), max(skipped - 1, 0), None), None)
    if head is None:
        raise SourceError("the source is empty" if not text else "the source ends before its header row")
    names = csv_names(head if skipped else [None] * len(head))
    columns = [f"c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField(_RAGGED, T.StringType())])
    options = {"sep": layout.delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAGGED, "multiLine": "true"}
    place_column = F.monotonically_increasing_id()
    if layout.encoding != "utf-16" and (skipped > 1 or _has_quoted_line_ends(spark, path, layout)):
        whole = _csv_records(spark, path, layout, text, skipped).select("place", F.from_csv("record", schema.simpleString(), options).alias("row")).select("place", "row.*")
        df, place_column = whole, F.col("place")
    else:
        reader = spark.read.schema(schema).options(**options).option("encoding", _CHARSETS[layout.encoding]).option("enforceSchema", True)
        if layout.encoding != "utf-16":
            # A header in the first line is dropped by the reader in whichever split it stands.
            reader, skipped = reader.option("multiLine", False).option("header", skipped == 1), 0
        rows = list(islice(csv.reader(io.StringIO(text, newline=""), delimiter=layout.delimiter), skipped))
        df = _below_preamble(reader.csv(path), rows, skipped)
        # A parser that skips the columns not asked for would not see how wide a row is.
        whole = _below_preamble(reader.option("columnPruning", False).csv(path), rows, skipped) if check else df
    if check and whole.where(F.col(_RAGGED).isNotNull()).select(columns[0], _RAGGED).head(1):
        raise SourceError("rows are not all as wide as the header")
    named = df.select(*columns, *([place_column.alias(_PLACE)] if place else []))
    return named.toDF(*names, *([place] if place else []))


def _csv_records(spark: SparkSession, path: str, layout: SourceFormat, text: str, skipped: int) -> DataFrame:
    """(place, record) of the records below the header row; blank ones go."""
    state = splits.CsvState(layout.delimiter, layout.encoding.removesuffix("-sig"), b"\n" if "\n" in text or "\r" not in text else b"\r")
    cut = splits.pieces(spark, path, state)
    found = splits.records(cut, state, splits.ranges(cut, state)[0])
    record = F.decode("record", _CHARSETS[layout.encoding])
    bare = F.regexp_replace(F.when(F.col("number") == 0, F.ltrim(record, F.lit("\ufeff"))).otherwise(record), "\r?[\r\n]$", "")
    return found.where(F.col("number") >= skipped).select("place", bare.alias("record")).where("record <> ''")


def _has_quoted_line_ends(spark: SparkSession, path: str, layout: SourceFormat) -> bool:
    """Whether some line has an odd number of quotes, as one with a cell that goes on in the next line; one scan of the lines, split as Spark likes."""
    lines = spark.read.text(path).select(count_char(F.col("value"), '"').alias("quotes"))
    return not lines.where(F.col("quotes") % 2 == 1).isEmpty()


def _below_preamble(df: DataFrame, rows: list[list[str]], skipped: int) -> DataFrame:
    """Without the preamble and the header of each file.  With multiLine a file is one split, read from its start: they are its partition's first rows."""
    if not skipped:
        return df
    return df.withColumn("__at", F.monotonically_increasing_id()).where(F.col("__at").bitwiseAND((1 << 33) - 1) >= _records(rows, skipped)).drop("__at")


def _records(rows: list[list[str]], skipped: int) -> int:
    """How many of the first rows Spark's reader keeps: it drops empty lines."""
    return sum(bool(r) for r in rows[:skipped])


def read_json(spark: SparkSession, path: str, layout: SourceFormat | None = None, join: bool = False, place: str | None = None) -> DataFrame:
    """A JSON array of objects; numbers keep the text that they have in the source, values that are objects or arrays too.

    The array is split over tasks.  All objects must have the same keys, in any order: one with a key more or less, however
    far down, raises SourceError, and so does an array that does not end.  With ``join`` the columns are all keys of all
    objects in the order in which they first appear, null where an object lacks them.  That costs one scan of the source.
    ``place`` names a column that rises in the order of the source.
    """
    layouts.check_kind(path if path.endswith(".json") else f"{path}/.json", "json", store.prefix(spark, path) if path.endswith(".json") else b"[")
    state = splits.JsonState()
    cut = splits.pieces(spark, path, state)
    found, last = splits.ranges(cut, state)
    if any(end != state.finish for end in last.values()):
        raise SourceError("a JSON source is one whole array")
    text = F.ltrim(F.col("record").cast("string"), F.lit("\ufeff[, \t\r\n"))
    # Behind the last object stands the array's end, with the brace that closes every piece.
    objects = splits.records(cut, state, found).select("place", text.alias("object")).where(~F.col("object").rlike(r"^\]\s*\}$"))
    keys = F.coalesce(F.json_object_keys("object"), F.array(F.lit(None).cast("string")))
    if join:
        seen = objects.select("place", F.posexplode(keys).alias("at", "key")).groupBy("key").agg(F.min(F.struct("place", "at")).alias("first"))
        names = [r.key for r in seen.orderBy("first").select("key").collect()]
        unequal = None in names
    else:
        first = objects.select("place", keys.alias("keys")).orderBy("place").first()
        names = list(first["keys"]) if first else []
        alike = F.array_sort(keys) == F.lit(sorted(names, key=lambda k: (k is None, k)))
        unequal = None in names or not objects.where(~F.coalesce(alike, F.lit(False))).isEmpty()
    if unequal:
        raise SourceError("the array holds something that is no object" if None in names else "the objects do not all have the same keys")
    schema = T.StructType([T.StructField(k, T.StringType()) for k in names])
    read = _with_value_texts(objects).select(F.from_json("object", schema, {"primitivesAsString": "true", "mode": "FAILFAST"}).alias("o"), "place")
    return read.select(*(F.col("o").getField(k).alias(k) for k in names), *([F.col("place").alias(place)] if place else []))


_STRING = re.compile(rb'("[^"\\]*+(?:\\.[^"\\]*+)*+")', re.S)
_NUMBER = re.compile(rb"-?[0-9][0-9.eE+-]*")
_TOKEN = re.compile(rb'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\]]|-?[0-9][0-9.eE+-]*|[^"{}\[\]0-9-]++|.', re.S)


def value_texts(data: bytes) -> bytes:
    """An object whose numbers, inner objects and arrays are strings that hold their text in the source."""
    parts = _STRING.split(data)
    bare = b"".join(parts[::2])
    if b"[" not in bare and bare.count(b"{") == 1:
        parts[::2] = [_NUMBER.sub(rb'"\g<0>"', p) for p in parts[::2]]
        return b"".join(parts)
    out: list[bytes] = []
    inner: list[bytes] = []
    depth = 0
    for token in _TOKEN.findall(data):
        opens, closes = token in (b"{", b"["), token in (b"}", b"]")
        depth += opens
        if depth > 1:
            inner.append(token)
        elif _NUMBER.match(token):
            out.append(b'"' + token + b'"')
        else:
            out.append(token)
        depth -= closes
        if depth == 1 and inner and closes:
            out.append(json.dumps(b"".join(inner).decode()).encode())
            inner = []
    return b"".join(out + inner)


def _with_value_texts(objects: DataFrame) -> DataFrame:
    """(place, object): Spark's parser of columns would write a number anew, 1.50 as 1.5, and inner objects too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([value_texts(x.as_py()).decode() for x in batch.column("object")], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("place"), texts], names=["place", "object"])

    return objects.select("place", F.col("object").cast("binary").alias("object")).mapInArrow(run, "place bigint, object string")


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    for _, e in ElementTree.iterparse(book.open("xl/sharedStrings.xml")):
        if e.tag.endswith("}si"):
            out.append("".join(t.text or "" for t in e.iter() if t.tag.endswith("}t")))
            e.clear()
    return out


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.parse(book.open("xl/styles.xml")).getroot()
    dated = set(range(14, 23)) | {45, 46, 47}
    for f in root.iterfind("m:numFmts/m:numFmt", _NS):
        if re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")), re.I):
            dated.add(int(f.get("numFmtId")))
    return {i for i, x in enumerate(root.iterfind("m:cellXfs/m:xf", _NS)) if int(x.get("numFmtId", 0)) in dated}


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str, bool]]:
    """(name, part, visible) of each sheet."""
    parts = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    found = []
    for s in ElementTree.parse(book.open("xl/workbook.xml")).getroot().iterfind("m:sheets/m:sheet", _NS):
        part = parts[s.get(f"{{{_NS['r']}}}id")].lstrip("/")
        found.append((s.get("name"), part if part.startswith("xl/") else f"xl/{part}", s.get("state", "visible") == "visible"))
    return found


def _number(text: str) -> str:
    value = float(text)
    return str(int(value)) if re.fullmatch(r"-?\d+", text) else str(value)


def sheet_rows(data: bytes, name: str | None = None) -> tuple[str, Iterator[list[str]]]:
    """The sheet's name and its rows as texts; without a name the first visible one that has a cell."""
    book = zipfile.ZipFile(io.BytesIO(data))
    strings, dated = _shared_strings(book), _date_styles(book)

    def cell(c: ElementTree.Element) -> str:
        kind, v = c.get("t"), c.find("m:v", _NS)
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter() if t.tag.endswith("}t"))
        if v is None or v.text is None:
            return ""
        if kind == "s":
            return strings[int(v.text)]
        if kind == "b":
            return "True" if v.text == "1" else "False"
        if kind in ("str", "e", "d"):
            return v.text
        return str(datetime(1899, 12, 30) + timedelta(days=float(v.text))) if int(c.get("s", 0)) in dated else _number(v.text)

    def rows(part: str) -> Iterator[list[str]]:
        for _, e in ElementTree.iterparse(book.open(part)):
            if e.tag.endswith("}row"):
                row: list[str] = []
                for c in e.iterfind("m:c", _NS):
                    at = len(row)
                    if ref := re.match(r"[A-Z]+", c.get("r", "")):
                        at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(ref[0]))) - 1
                    row += [""] * (at - len(row)) + [cell(c)]
                e.clear()
                yield row

    sheets = _sheets(book)
    if name is not None:
        part = next((p for n, p, _ in sheets if n == name), None)
        if part is None:
            raise SourceError(f"no sheet {name!r}")
        return name, rows(part)
    for found, part, visible in sheets:
        if visible and any(any(c.strip() for c in r) for r in rows(part)):
            return found, rows(part)
    return (sheets[0][0] if sheets else ""), iter(())


def sheet_head(spark: SparkSession, path: str, sheet: str | None, rows: int) -> tuple[str, list[list[str]]]:
    """The name of the first workbook's sheet and its first rows, found by a task; the workbook does not come to the driver."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                name, found = sheet_rows(bytes(content), sheet)
                yield pd.DataFrame({"name": [name], "rows": [list(islice(found, rows))]})

    found = spark.read.format("binaryFile").load(path).select("content").limit(1).mapInPandas(run, "name string, rows array<array<string>>").first()
    if found is None:
        raise SourceError("the source is empty")
    return found["name"], [list(r) for r in found["rows"]]


def read_excel(spark: SparkSession, path: str, layout: SourceFormat, check: bool = True, place: str | None = None) -> DataFrame:
    """One sheet as strings, as a cell shows them: a float 5.0 is '5.0', a date '2023-01-03 00:00:00', nothing is ''.

    The file is opened where its task runs, sheet by sheet of a folder of files if ``path`` names one; the format allows
    some million rows a file.  A row that has a cell beyond the header's last raises SourceError; that costs one scan, which
    ``check=False`` leaves out, and then the job that meets such a row fails.  A shorter row is filled up with ''.
    """
    head = sheet_head(spark, path, layout.sheet, max(layout.header_row or 1, 1))[1]
    if layout.header_row and len(head) < layout.header_row:
        raise SourceError("the source ends before its header row" if head else "the sheet has no columns")
    row = head[(layout.header_row or 1) - 1] if head else []
    while layout.header_row and row and not row[-1].strip():
        row = row[:-1]
    names = [c.strip() or f"col_{i}" for i, c in enumerate(row)] if layout.header_row else [f"col_{i}" for i in range(len(row))]
    if not names:
        raise SourceError("the sheet has no columns")
    skipped, sheet, width = layout.header_row or 0, layout.sheet, len(names)

    def blocks(content: bytes) -> Iterator[list[list[str]]]:
        rows = islice(sheet_rows(content, sheet)[1], skipped, None)
        while block := list(islice(rows, 10_000)):
            yield block

    def wide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for block in blocks(bytes(content)):
                    found = [len(r) for r in block if any(r[width:])]
                    if found:
                        yield pd.DataFrame({"width": found})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                for block in blocks(bytes(content)):
                    if any(any(r[width:]) for r in block):
                        raise SourceError("a row is wider than the header")
                    yield pd.DataFrame([(r + [""] * width)[:width] for r in block], columns=columns)

    columns = [f"c{i}" for i in range(width)]
    files = spark.read.format("binaryFile").load(path).select("content")
    if check and not files.mapInPandas(wide, "width int").isEmpty():
        raise SourceError("a row is wider than the header")
    read = files.mapInPandas(run, ", ".join(f"{c} string" for c in columns)).toDF(*csv_names(names))
    return read.withColumn(place, F.monotonically_increasing_id()) if place else read


def workbook_bytes(sheet: str, rows: list[list]) -> bytes:
    """A small workbook of one sheet: texts as inline strings, numbers as numbers, for fixtures and hand-overs."""
    ns, office = _NS["m"], _NS["r"]

    def cell(value, at: str) -> str:
        return f'<c r="{at}"><v>{value}</v></c>' if isinstance(value, (int, float)) else f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'

    def place(column: int, row: int) -> str:
        letters = ""
        while column >= 0:
            letters, column = chr(65 + column % 26) + letters, column // 26 - 1
        return f"{letters}{row}"

    body = "".join(f'<row r="{i}">' + "".join(cell(v, place(j, i)) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
