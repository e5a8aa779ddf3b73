"""Whole-table operators, sources and runs on small inputs."""

import json
import random
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from grainmill.config import ColumnConfig, InstanceConfig, InstanceNotFound, InvalidRequest, InvalidState, Options, SourceError, SourceFormat, Thresholds, position_key
from grainmill.functions import values
from grainmill.operators import convert, headers, increments, infer, issues, profile, quality, rows, sample, trace
from grainmill.plans.engine import Engine, FileStore, estimate_seconds
from grainmill.sources import layout, log, readers, sinks, store
from grainmill.streaming import publish as streams
from grainmill.streaming.convert import convert_stream

COLUMNS = {"k": ColumnConfig("identifier", identifier_kind="primary"), "n": ColumnConfig("integer"), "d": ColumnConfig("date")}


def small(spark):
    return spark.createDataFrame([("a", "1", "2023-01-01"), ("b", "x", "n/a"), (" ", "", None), ("c", None, "01/02/2023"), ("c", "5", "?!")], "k string, n string, d string").coalesce(1)


def test_headers():
    assert headers.canonical_headers(["Order ID", "", "a", "a", "a_2", "__x__", "Ünï"]) == ["order_id", "column", "a", "a_2", "a_2_2", "x", "n"]
    assert headers.csv_names(["id", "ID", None, "id"]) == ["id", "ID_1", "column2", "id_2"]
    assert headers.raw_to_canonical(["x", "x"]) == {"x": "x", "x#2": "x_2"}
    assert [position_key(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_convert_and_trace(spark):
    options = Options(null_tokens=("N/A",), trace_mode=("full",), full_raw_row=True)
    made = convert.convert(small(spark), COLUMNS, options, keep_raw=True)
    got = [r.asDict() for r in made.orderBy("_row_index").collect()]
    assert [r["_row_index"] for r in got] == [1, 2, 3, 4]
    assert [r["_parse_error_count"] for r in got] == [0, 1, 0, 1]
    assert [r["n"] for r in got] == [1, None, None, 5]
    assert json.loads(got[1]["_parse_issues"]) == {"n": {"raw": "x", "code": "INVALID_INTEGER"}}
    assert json.loads(got[2]["_raw_row"]) == {"k": "c", "n": None, "d": "01/02/2023"}
    assert trace.trace(made, COLUMNS, ("full",)).count() == 12
    assert {(r.row_index, r.column_name) for r in trace.trace(made, COLUMNS, ("issues",)).collect()} == {(2, "n"), (4, "d")}
    changed = {(r.row_index, r.column_name) for r in trace.trace(made, COLUMNS, ("changes",)).collect()}
    assert changed == {(2, "d"), (3, "d")}
    found = {r.column_name: r for r in quality.column_quality(made, list(COLUMNS)).collect()}
    assert found["n"].error_count == 1 and found["n"].parse_success_ratio == pytest.approx(2 / 3)
    one = quality.quality(made, list(COLUMNS)).first()
    assert one.error_count == 2 and one.attempted_count == 10 and one.quality_score == pytest.approx(80)


def test_value_and_issue_complement_each_other(spark):
    made = convert.convert_cells(small(spark), COLUMNS, ("n/a",))
    for c in COLUMNS:
        wrong = made.where(~F.col(f"`__null__{c}`") if f"__null__{c}" in made.columns else F.lit(True)).where(F.col(f"`__typed__{c}`").isNotNull() & F.col(f"`__issue__{c}`").isNotNull())
        assert wrong.isEmpty()


def test_empty_table(spark):
    empty = small(spark).limit(0)
    made = convert.convert(empty, COLUMNS, keep_raw=True)
    assert made.count() == 0
    assert quality.quality(made, list(COLUMNS)).first().quality_score == 100
    assert profile.profile(empty, COLUMNS)["k"]["distinct_ratio"] == 1.0


def test_row_index_over_many_partitions(spark):
    df = spark.range(10_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "").otherwise("x").alias("c")).repartition(7)
    got = rows.with_row_index(rows.drop_empty_rows(df, ["c"]), "i", ["id"]).orderBy("id").collect()
    assert [r.i for r in got] == list(range(1, len(got) + 1))


def test_profile_and_issues(spark):
    df = spark.createDataFrame([("1", "$5 CR", "01/02/2023"), ("2", "€1.234,5", "03/04/2023"), ("2", "7.25", None)], "k string, m string, d string")
    columns = {"k": ColumnConfig("identifier", identifier_kind="primary"), "m": ColumnConfig("accounting"), "d": ColumnConfig("date")}
    found = profile.profile(df, columns)
    assert found["k"]["duplicate_count"] == 1 and found["m"]["symbol_distribution"] == {"$": 1, "€": 1} and found["m"]["max_scale"] == 2
    codes = {i.code: i.severity for c, config in columns.items() for i in issues.column_issues(c, config, found[c])}
    assert codes == {"IDENTIFIER_DUPLICATES": "ERROR", "MIXED_CURRENCY": "WARNING", "MIXED_NUMBER_FORMAT": "INFO", "DATE_ORDER_AMBIGUOUS": "WARNING", "SIGN_MARKER_CONVENTION": "WARNING"}
    assert profile.pattern_consistency(found) == pytest.approx(1 / 3)
    two = issues.dataset_issues({"a": columns["k"], "b": columns["k"]}, SourceFormat(header_row=3))
    assert [i.code for i in two] == ["PREAMBLE_ROWS_SKIPPED", "MULTIPLE_PRIMARY_KEYS"]


@pytest.mark.parametrize("score, worst, severities, want", [(100, 100, [], "READY"), (100, 100, ["WARNING"], "READY_WITH_WARNINGS"), (94.9, 94.9, [], "READY_WITH_WARNINGS"), (84.9, 100, [], "BLOCKED"), (99, 50, [], "BLOCKED"), (100, 100, ["ERROR"], "BLOCKED"), (100, 100, ["INFO"], "READY")])
def test_verdict(spark, score, worst, severities, want):
    assert quality.verdict(score, worst, severities) == want
    column = quality.verdict_column(F.lit(score), F.lit(worst), F.lit(severities.count("ERROR")), F.lit(severities.count("WARNING")))
    assert spark.range(1).select(column.alias("v")).first().v == want


def test_type_inference(spark):
    made = {
        "id": [f"A-{i}" for i in range(20)], "order_id": [str(i) for i in range(20)], "flag": ["yes", "no"] * 10, "zero_one": ["0", "1"] * 10, "n": ["1,234", "7"] * 10, "x": ["1.5", "2.25"] * 10,
        "pct": ["5%", "6 %"] * 10, "cur": ["$5", "7"] * 10, "acc": ["$5 CR", "$7"] * 10, "sig": ["5 CR", "7.5"] * 10, "day": ["13/02/2023", "01/02/2023"] * 10, "ts": ["2023-01-01 10:00"] * 20, "clock": ["10:00", "1:05 PM"] * 10,
        "cc": ["US", "de"] * 10, "txt": ["hello there", "word"] * 10,
    }
    df = spark.createDataFrame(list(zip(*made.values())), ", ".join(f"{c} string" for c in made))
    got = infer.infer_types(df, codes=True)
    assert {c: got[c].type for c in made} == {"id": "identifier", "order_id": "identifier", "flag": "boolean", "zero_one": "integer", "n": "integer", "x": "decimal", "pct": "percentage", "cur": "currency", "acc": "accounting", "sig": "signed", "day": "date", "ts": "datetime", "clock": "time", "cc": "country_code", "txt": "string"}
    assert got["day"].day_first and got["id"].identifier_kind == "primary" and got["order_id"].identifier_kind == "foreign"
    assert infer.infer_null_tokens(spark.createDataFrame([(" N/A ", "x"), ("-", "y")], "a string, b string")) == ("-", "n/a")


def test_csv_layouts(spark, tmp_path):
    def read(name, data, wanted=None):
        (tmp_path / name).write_bytes(data)
        found = layout.csv_layout(data)
        if wanted:
            assert (found.header_row, found.delimiter, found.encoding) == wanted, name
        return readers.read_csv(spark, f"file://{tmp_path}/{name}", found)

    df = read("a.csv", "name;city\nÉa;x\nb;\"y\nz\"\n".encode(), (1, ";", "utf-8"))
    assert [tuple(r) for r in df.collect()] == [("Éa", "x"), ("b", "y\nz")]
    df = read("p.csv", b"Report\nMade today\nname,city,n\na,b,1\nc,d,2\ne,f,3\n", (3, ",", "utf-8"))
    assert df.columns == ["name", "city", "n"] and df.count() == 3
    df = read("u.csv", "name,city\nä,ö\n".encode("utf-8-sig"), (1, ",", "utf-8-sig"))
    assert df.columns == ["name", "city"] and df.first().name == "ä"
    df = read("l.csv", "name,city\nä,ö\nü,ß\n".encode("latin-1"), (1, ",", "latin-1"))
    assert df.first().name == "ä"
    (tmp_path / "r.csv").write_bytes(b"a,b\n1,2\n3\n")
    with pytest.raises(SourceError):
        readers.read_csv(spark, f"file://{tmp_path}/r.csv", SourceFormat())
    assert layout.encoding_of("é".encode()[:1] + b"") in ("utf-8", "latin-1") and layout.encoding_of("aé".encode()[:-1]) == "utf-8"
    with pytest.raises(SourceError):
        layout.verify(b"a;b\n1;2\n", SourceFormat(delimiter=","))


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1.50, "b": "x"}, {"b": null, "a": 2}]')
    df = readers.read_json(spark, f"file://{tmp_path}/a.json")
    assert [tuple(r) for r in df.collect()] == [("1.50", "x"), ("2", None)]
    for bad in (b'[{"a": 1}, {"b": 1}]', b"[1]", b'{"a": 1}'):
        with pytest.raises(SourceError):
            layout.json_keys(bad)
    with pytest.raises(SourceError):
        layout.check_kind("x.json", "json", b"{}")


def workbook(path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>Name</t></is></c><c r="C1" t="s"><v>0</v></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>5.5</v></c><c r="C2" s="1"><v>44929</v></c></row><row r="3"><c r="B3"><v>7</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Hidden" state="hidden" sheetId="1" r:id="r1"/><sheet name="Data" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", sheet)
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>When</t></si><si><t>Ann</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')


def test_excel(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    df = readers.read_excel(spark, f"file://{tmp_path}/a.xlsx", SourceFormat("excel"))
    assert df.columns == ["Name", "col_1", "When"]
    assert [tuple(r) for r in df.collect()] == [("Ann", "5.5", "2023-01-03 00:00:00"), ("", "7", "True")]


def test_run(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("Order ID,Amount,Paid,Day\n" + "".join(f"{i},\"$1,{i:03d}.55\",{'yes' if i % 2 else 'no'},{i % 28 + 1}/02/2023\n" for i in range(100)) + "101,abc,yes,n/a\n")
    engine = Engine(spark)
    run = engine.suggest(f"file://{tmp_path}/orders.csv")
    assert run.status == "AWAITING_CONFIRMATION" and [c.type for c in run.suggested.columns.values()] == ["identifier", "currency", "boolean", "date"]
    assert run.display["row_count"] == 101 and run.suggested.columns["D"].day_first
    with pytest.raises(InvalidState):
        engine.convert(run.id, f"file://{tmp_path}/out")
    engine.confirm(run.id)
    engine.profile(run.id)
    run = engine.convert(run.id, f"file://{tmp_path}/out", single_file=True)
    assert run.status == "READY_WITH_WARNINGS"
    out = spark.read.parquet(sinks.artifacts(spark, f"file://{tmp_path}/out")["converted"])
    assert out.columns == ["order_id", "amount", "paid", "day", "_row_index", "_parse_issues"] and dict(out.dtypes)["amount"] == "decimal(18,2)"
    assert [r._row_index for r in out.orderBy("_row_index").collect()] == list(range(1, 102))
    assert spark.read.parquet(run.artifacts["trace"]).count() == 1
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert manifest["quality_summary"]["error_count"] == 1 and manifest["artifacts"]["trace"].endswith("/trace.parquet")
    assert InstanceConfig.from_dict(json.loads(engine.config_json(run.id))).columns["D"].day_first


def test_failed_run(spark):
    engine = Engine(spark)
    run = engine.create_confirmed("file:///nowhere/x.csv", InstanceConfig({"A": ColumnConfig()}))
    with pytest.raises(SourceError):
        engine.profile(run.id)
    assert run.status == "FAILED"


def test_options():
    with pytest.raises(InvalidRequest):
        Thresholds(80, 90)
    with pytest.raises(InvalidRequest):
        Options(trace_mode=())
    with pytest.raises(InvalidRequest):
        SourceFormat(delimiter=";;")
    assert [estimate_seconds(n) for n in (5, 10_000, 55_000, 10_000_000, 20_000_000)] == [5, 5, 18, 900, 1700]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    small(spark).write.parquet(f"file://{src}")
    raw = spark.readStream.schema("k string, n string, d string").parquet(f"file://{src}")
    query = convert_stream(raw, COLUMNS, ("n/a",)).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("streamed").orderBy("k", "n").collect()
    assert len(got) == 4 and sum(r._parse_error_count for r in got) == 2


def test_a_new_run_leaves_former_tables_whole(spark, tmp_path):
    made = convert.convert(small(spark), COLUMNS, keep_raw=True)
    first = sinks.publish(made, COLUMNS, Options(), f"file://{tmp_path}/out", {}, [])
    second = sinks.publish(made.where("_row_index > 1"), COLUMNS, Options(), f"file://{tmp_path}/out", {}, [])
    assert sinks.artifacts(spark, f"file://{tmp_path}/out") == second and first["converted"] != second["converted"]
    assert spark.read.parquet(first["converted"]).count() == 4 and spark.read.parquet(second["converted"]).count() == 3


def test_index_by_stored_place(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").cast("string").alias("c")).repartition(5).withColumn("place", F.monotonically_increasing_id())
    df.write.parquet(f"file://{tmp_path}/t")
    got = rows.indexed_by_place(spark.read.parquet(f"file://{tmp_path}/t").where("c % 7 != 0"), "i", "place")
    assert got.columns == ["c", "i"]
    want = [r.c for r in df.where("c % 7 != 0").orderBy("place").collect()]
    assert sorted(r.i for r in got.collect()) == list(range(1, len(want) + 1))


def test_renames_and_paths(spark, tmp_path):
    df = small(spark)
    assert headers.renamed(df, {"k": "Customer Key"}).columns == ["customer_key", "n", "d"]
    for bad in ({"x": "y"}, {"k": "n"}):
        with pytest.raises(InvalidRequest):
            headers.renamed(df, bad)
    assert store.within(spark, f"{tmp_path}/a/../b.csv", [str(tmp_path)]).endswith("/b.csv")
    for bad in (f"{tmp_path}/../x.csv", f"{tmp_path}x/y.csv"):
        with pytest.raises(InvalidRequest):
            store.within(spark, bad, [str(tmp_path)])


def test_csv_is_split_unless_a_cell_holds_a_line_end(spark, tmp_path):
    (tmp_path / "plain.csv").write_text("a,b\n" + "".join(f'{i},"x, ""{i}"""\n' for i in range(2000)))
    (tmp_path / "lines.csv").write_text("a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        plain, lines = (readers.read_csv(spark, f"file://{tmp_path}/{n}.csv", SourceFormat()) for n in ("plain", "lines"))
        assert min(plain.rdd.getNumPartitions(), lines.rdd.getNumPartitions()) > 4
        assert sorted(tuple(r) for r in plain.collect()) == sorted((str(i), f'x, "{i}"') for i in range(2000))
        assert sorted(tuple(r) for r in lines.collect()) == sorted((str(i), f"x\n{i}") for i in range(2000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_large_cells(spark, tmp_path):
    (tmp_path / "big.csv").write_text("name,text\nrow," + "x" * 200_000 + "\n")
    found = layout.csv_layout((tmp_path / "big.csv").read_bytes())
    assert len(readers.read_csv(spark, f"file://{tmp_path}/big.csv", found).first().text) == 200_000


def test_a_header_with_the_word_identifier_is_a_key(spark):
    df = spark.createDataFrame([(f"a-{c}x", str(i)) for i, c in enumerate("abcdefghij")], "customer_identifier string, n string")
    assert infer.infer_types(df)["customer_identifier"].identifier_kind == "opaque" and infer.infer_types(df)["customer_identifier"].type == "identifier"


def test_runs_outlive_their_process(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,n\n" + "".join(f"x{i},{i}\n" for i in range(20)))
    first = Engine(spark, FileStore(spark, f"file://{tmp_path}/runs"))
    run = first.resolve_layout(f"file://{tmp_path}/a.csv")
    assert run.status == "LAYOUT_RESOLVED"
    second = Engine(spark, FileStore(spark, f"file://{tmp_path}/runs"))
    assert second.type_columns(run.id).suggested.columns["B"].type == "integer"
    second.confirm(run.id)
    third = Engine(spark, FileStore(spark, f"file://{tmp_path}/runs"))
    third.profile(run.id)
    again = FileStore(spark, f"file://{tmp_path}/runs").get(run.id)
    assert again == third.runs.get(run.id) and again.status == "PROFILED" and again.confirmed.columns["B"].type == "integer"
    with pytest.raises(InstanceNotFound):
        third.runs.get("../x")
    with pytest.raises(InvalidState):
        third.type_columns(run.id)


def test_command_line(spark, tmp_path, capsys):
    from grainmill.__main__ import main

    (tmp_path / "a.csv").write_text("name,n\n" + "".join(f"x{i},{i}\n" for i in range(20)))
    assert main([f"file://{tmp_path}/a.csv", f"file://{tmp_path}/out", "--within", f"file://{tmp_path}"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert spark.read.parquet(said["artifacts"]["converted"]).count() == 20 and said["status"].startswith("READY")
    assert main([f"file://{tmp_path}/a.csv", f"file://{tmp_path}/out", "--suggest-only"]) == 0


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def in_order(df, place="place"):
    rows = df.orderBy(place).drop(place).collect()
    return [tuple(r) for r in rows]


def test_json_arrays_are_split(spark, tmp_path, small_ranges):
    """Strings with braces, quotes and backslashes, nested values, and objects longer than several ranges."""
    rng = random.Random(1)
    odd = ["}", "{", '"', "\\", '\\"', "[", "]", ",", "é", "\n", "1.50", "a", "b", " "]
    objects = []
    for i in range(300):
        text = "".join(rng.choice(odd) for _ in range(rng.choice((0, 5, 30, 3000 if i % 50 == 7 else 10))))
        objects.append({"n": i, "text}": text, "deep": rng.choice([None, {"x": {"}": [1, {"y": "]}"}]}}, [], [[{}]], True, "x"])})
    for indent, name in ((None, "one"), (1, "many")):
        (tmp_path / f"{name}.json").write_bytes(b"\xef\xbb\xbf" * (indent is None) + json.dumps(objects, indent=indent, ensure_ascii=indent is None).encode())
        df = readers.read_json(spark, f"file://{tmp_path}/{name}.json", place="place")
        assert df.columns == ["n", "text}", "deep", "place"] and df.rdd.getNumPartitions() > 10
        rows = in_order(df)
        assert [r[:2] for r in rows] == [(str(o["n"]), o["text}"]) for o in objects]
        value = lambda x: x if x is None or isinstance(x, str) else "true" if x is True else json.dumps(x)
        assert [r[2] if r[2] in (None, "x", "true") else json.dumps(json.loads(r[2])) for r in rows] == [value(o["deep"]) for o in objects]


def test_json_numbers_keep_their_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1.50, "b": -0e10, "c": {"d": 1.50, "e": [2.0]}, "f": "1.0 -5", "g": 12345678901234567890.10}]')
    assert tuple(readers.read_json(spark, f"file://{tmp_path}/a.json").first()) == ("1.50", "-0e10", '{"d": 1.50, "e": [2.0]}', "1.0 -5", "12345678901234567890.10")


def test_late_keys_are_found(spark, tmp_path, small_ranges):
    rows = [{"a": i, "b": "x" * 20} for i in range(500)]
    for late in ({"a": 1, "b": 2, "c": 3}, {"a": 1}, {"a": 1, "c": 2}, 5, [1], {}):
        (tmp_path / "a.json").write_text(json.dumps([*rows, late, *rows[:3]]))
        with pytest.raises(SourceError):
            readers.read_json(spark, f"file://{tmp_path}/a.json")
        if isinstance(late, dict):
            df = readers.read_json(spark, f"file://{tmp_path}/a.json", join=True, place="place")
            assert df.columns == ["a", "b", *(["c"] if "c" in late else []), "place"]
            assert in_order(df)[500] == tuple(None if c not in late else str(late[c]) for c in df.columns[:-1])
            assert df.count() == 504
        else:
            with pytest.raises(SourceError):
                readers.read_json(spark, f"file://{tmp_path}/a.json", join=True)
    (tmp_path / "a.json").write_text(json.dumps([{"a": 1, "b": 2}, {"b": 3, "a": 4}]))
    assert [tuple(r) for r in readers.read_json(spark, f"file://{tmp_path}/a.json").collect()] == [("1", "2"), ("4", "3")]


@pytest.mark.parametrize("data", ['[{"a": 1}', '[{"a": 1', '[{"a": "1}]', "[", '[{"a": 1}]]', '[{"a": 1}] 5', '{"a": 1}', '[{"a": 1},, {"a": 2}'])
def test_arrays_that_do_not_end_are_refused(spark, tmp_path, data):
    (tmp_path / "a.json").write_text(data)
    with pytest.raises(SourceError):
        readers.read_json(spark, f"file://{tmp_path}/a.json").collect()


def test_empty_arrays(spark, tmp_path):
    for data in ("[]", " [ \n ] \n", "[{}]"):
        (tmp_path / "a.json").write_text(data)
        df = readers.read_json(spark, f"file://{tmp_path}/a.json")
        assert df.columns == [] and df.count() == data.count("{")


def csv_text(rng, n, ends, delimiter, preamble):
    cell = lambda: rng.choice(["x", "", 'a"b', '"q"', '"a""b"', f'"m{ends}n"', f'"{ends}"', f'"{delimiter}"', '"a"b', "é", "5' 6\"", f'"""{ends}""{delimiter}"', '"' + "long " * rng.choice((1, 300)) + ends + '"'])
    rows = [delimiter.join([f"r{i}", cell(), cell()]) for i in range(n)]
    return ends.join([*preamble, delimiter.join(("k", "b", "c")), *rows]) + rng.choice(["", ends])


@pytest.mark.parametrize("ends, delimiter, encoding, preamble", [("\n", ",", "utf-8", []), ("\r\n", ";", "utf-8-sig", ["Title", "", '"made\r\ntoday"']), ("\n", "\t", "latin-1", ["é"]), ("\r", "|", "utf-8", ["x"])])
def test_split_csv_is_what_one_task_reads(spark, tmp_path, small_ranges, ends, delimiter, encoding, preamble):
    rng = random.Random(2)
    (tmp_path / "a.csv").write_bytes(csv_text(rng, 400, ends, delimiter, preamble).encode(encoding))
    layout_ = SourceFormat("csv", len(preamble) + 1, delimiter, encoding)
    df = readers.read_csv(spark, f"file://{tmp_path}/a.csv", layout_, check=False, place="place")
    assert df.columns == ["k", "b", "c", "place"] and (df.rdd.getNumPartitions() > 10)
    options = {"sep": delimiter, "multiLine": True, "escape": '"', "header": False, "encoding": {"latin-1": "ISO-8859-1"}.get(encoding, "UTF-8")}
    whole = spark.read.schema("k string, b string, c string").options(**options).csv(f"file://{tmp_path}/a.csv").collect()
    want = [tuple(r) for r in whole][1 + sum(bool(p) for p in preamble) :]
    # The cells keep the line ends of the source, where the reader of whole files writes them anew.
    plain = lambda c: c and c.replace("\r\n", "\n").replace("\r", "\n")
    assert [tuple(map(plain, r)) for r in in_order(df)] == [tuple(map(plain, r)) for r in want] and len(want) == 400
    assert ends == "\n" or any(ends in (r[1] or "") for r in in_order(df))


def test_headers_beyond_the_source_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    with pytest.raises(SourceError):
        readers.read_csv(spark, f"file://{tmp_path}/a.csv", SourceFormat(header_row=5))


def test_wide_rows_of_a_sheet_are_refused(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(readers.workbook_bytes("S", [["A", "B"], ["1", "2", ""], ["3"], ["1", "2", "EXTRA"]]))
    with pytest.raises(SourceError):
        readers.read_excel(spark, f"file://{tmp_path}/a.xlsx", SourceFormat("excel"))
    (tmp_path / "b.xlsx").write_bytes(readers.workbook_bytes("S", [["T"], ["A", "B", ""], ["1", "2", ""], ["3"]]))
    found = readers.read_excel(spark, f"file://{tmp_path}/b.xlsx", SourceFormat("excel", header_row=2))
    assert found.columns == ["A", "B"] and [tuple(r) for r in found.collect()] == [("1", "2"), ("3", "")]
    with pytest.raises(SourceError):
        readers.read_excel(spark, f"file://{tmp_path}/b.xlsx", SourceFormat("excel", header_row=9))


def published(spark, folder, ids, single_file=False):
    columns, options = {"n": ColumnConfig("integer")}, Options(full_raw_row=True)
    made = convert.convert(spark.range(ids).select("id", F.col("id").cast("string").alias("n")), columns, options, order_by=("id",), keep_raw=True)
    return sinks.publish(made, columns, options, folder, {"rows": ids}, [], single_file=single_file)


def test_versions_are_published_one_after_the_other(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    with pytest.raises(InvalidRequest):
        sinks.artifacts(spark, folder)
    for rows in (3, 5):
        found = published(spark, folder, rows)
        assert spark.read.parquet(found["converted"]).count() == rows
    assert sinks.versions(spark, folder) == [1, 2]
    assert spark.read.parquet(sinks.artifacts(spark, folder, 1)["converted"]).count() == 3
    assert json.loads(store.read_text(spark, sinks.artifacts(spark, folder, 1)["manifest"]))["quality_summary"] == {"rows": 3}
    assert json.loads((tmp_path / "out/manifest.json").read_text())["version"] == 2
    with pytest.raises(InvalidRequest):
        sinks.artifacts(spark, folder, 3)


def test_a_crash_at_any_step_leaves_whole_versions(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/out"
    published(spark, folder, 3)

    def crash(*_):
        raise OSError("crashed")

    for step, whole in (("put_if_absent", [1]), ("_rename", [1]), ("move", [1, 2])):
        with monkeypatch.context() as m:
            m.setattr(store, step, crash)
            with pytest.raises(OSError):
                published(spark, folder, 4)
        assert sinks.versions(spark, folder) == whole
        assert spark.read.parquet(sinks.artifacts(spark, folder)["converted"]).count() == (4 if len(whole) == 2 else 3)
    assert spark.read.parquet(published(spark, folder, 5)["converted"]).count() == 5 and sinks.versions(spark, folder) == [1, 2, 3]


def test_of_writers_at_once_each_has_a_version(spark, tmp_path):
    with ThreadPoolExecutor(6) as pool:
        took = list(pool.map(lambda i: [n for n in range(1, 9) if store.put_if_absent(spark, f"file://{tmp_path}/{n}.json", str(i))], range(1)))
    assert took == [list(range(1, 9))] and not store.put_if_absent(spark, f"file://{tmp_path}/3.json", "other")
    assert store.read_text(spark, f"file://{tmp_path}/3.json") == "0" and not [f for f in tmp_path.iterdir() if f.name.endswith(".tmp")]
    folder = f"file://{tmp_path}/out"
    real, taken = store.put_if_absent, []

    def late(spark_, path, text):
        """Another writer takes each of the first two numbers just before this one."""
        if len(taken) < 2:
            taken.append(path)
            real(spark_, path, text)
        return real(spark_, path, text)

    with pytest.MonkeyPatch.context() as m:
        m.setattr(store, "put_if_absent", late)
        published(spark, folder, 2)
    assert sinks.versions(spark, folder) == [1, 2, 3]


def test_row_groups_have_a_hundred_thousand_rows(spark, tmp_path):
    found = published(spark, f"file://{tmp_path}/out", 250_000, single_file=True)
    (part,) = (tmp_path / "out").glob("run-*/converted.parquet/*.parquet")
    assert found["converted"].endswith("converted.parquet")
    meta = pq.ParquetFile(part).metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [100_000, 100_000, 50_000]


def test_a_stream_stopped_and_started_gives_the_result_of_the_batch(spark, tmp_path, monkeypatch):
    top, schema = f"file://{tmp_path}", "k string, n string, d string"
    everything = [(f"k{i}", str(i) if i % 3 else "x", f"2023-01-{i % 28 + 1:02d}") for i in range(90)]
    start = lambda **trigger: streams.publish_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in/*"), COLUMNS, f"{top}/out", f"{top}/state", trigger=trigger or None)
    feed = lambda i: spark.createDataFrame(everything[30 * i : 30 * i + 30], schema).coalesce(1).write.parquet(f"{top}/in/{i}")
    feed(0), feed(1)
    start(once=True).awaitTermination()
    put = store.put_if_absent
    # A batch that dies before and one that dies after its entry is put: both are run again.
    for fails in (lambda *a: (_ for _ in ()).throw(OSError("lost")), lambda *a: put(*a) and (_ for _ in ()).throw(OSError("lost"))):
        monkeypatch.setattr(store, "put_if_absent", fails)
        feed(2) if not (tmp_path / "in/2").exists() else None
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
    monkeypatch.setattr(store, "put_if_absent", put)
    start().awaitTermination()
    got = log.read(spark, f"{top}/out").orderBy("_row_index").collect()
    assert [r._row_index for r in got] == list(range(1, 91))
    want = convert.convert(spark.createDataFrame(everything, schema), COLUMNS).collect()
    shown = lambda rows_: sorted((r.k, r.n, r.d, r._parse_error_count) for r in rows_ if r.n is not None) + sorted(r.k for r in rows_ if r.n is None)
    assert shown(got) == shown(want)
    assert [r.row_end for r in log.entries(spark, f"{top}/out").orderBy("name").collect()] == sorted({r.row_end for r in log.entries(spark, f"{top}/out").collect()})
    with pytest.raises(Exception, match="has 0+ of"):
        streams.publish_stream(spark.readStream.schema(schema).parquet(f"{top}/in/*"), COLUMNS, f"{top}/out", f"{top}/other").awaitTermination()


def test_issue_counts_leave_late_rows_out(spark, tmp_path):
    top, schema = f"file://{tmp_path}", "at timestamp_ntz, _parse_error_count int"
    started = lambda: streams.publish_issue_counts(spark.readStream.schema(schema).parquet(f"{top}/in/*"), "at", f"{top}/out", f"{top}/state").awaitTermination()
    for i, hours in enumerate(([0, 0, 5], [4, 5, 0], [5])):
        spark.sql("select explode(array({})) as h".format(", ".join(map(str, hours)))).selectExpr("timestamp_ntz'2024-01-01 00:10:00' + make_dt_interval(0, h) as at", "1 as _parse_error_count").write.parquet(f"{top}/in/{i}")
        started()
    # The second batch's row at hour 0 comes more than an hour after hour 5.
    assert [(r.window_start.hour, r.row_count, r.error_count) for r in streams.issue_counts_of(spark, f"{top}/out").orderBy("window_start").collect()] == [(0, 2, 2), (4, 1, 1), (5, 3, 3)]


@pytest.mark.parametrize("k", [1, 7, 256])
def test_first_values_are_those_of_a_slow_reading(spark, tmp_path, k):
    draw = random.Random(k)
    made = [(draw.choice(["", " ", None, "n/a", " x ", "y", "y"]), draw.choice([None, ""]), str(i) if i > 700 else None, f"v{i}") for i in range(900)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "i int, a string, none string, late string, `b.c d` string").repartitionByRange(11, "i").sortWithinPartitions("i").drop("i")
    df.withColumn("place", F.monotonically_increasing_id()).write.parquet(f"file://{tmp_path}/t")
    got = {}
    for r in sample.first_values(spark.read.parquet(f"file://{tmp_path}/t"), k, "place", ("n/a",)).orderBy("column_name", "position").collect():
        got.setdefault(r.column_name, []).append((r.position, r.value))
    want = {c: [v.strip() for r in made if (v := r[i]) is not None and v.strip() not in ("", "n/a")][:k] for i, c in enumerate(("a", "none", "late", "b.c d"))}
    assert got == {c: list(enumerate(v, 1)) for c, v in want.items() if v}


def test_first_values_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string, place bigint")
    assert sample.first_values(empty, 3, "place").count() == 0 and sample.first_values(empty.drop("a"), 3, "place").count() == 0


def test_types_come_from_values_beyond_the_first_rows(spark, tmp_path):
    (tmp_path / "s.csv").write_text("key,when,empty\n" + "".join(f"a{i},{'' if i < 400 else '2023-05-17'},\n" for i in range(500)))
    run = Engine(spark).suggest(f"file://{tmp_path}/s.csv")
    assert [c.type for c in run.suggested.columns.values()][1:] == ["date", "string"]
    assert run.display["values"] == {"key": [f"a{i}" for i in range(10)], "when": ["2023-05-17"] * 10, "empty": []}


def test_merged_profiles_are_those_of_the_whole(spark, tmp_path):
    columns = {"s": ColumnConfig("string"), "k": ColumnConfig("identifier"), "m": ColumnConfig("accounting"), "c": ColumnConfig("currency"), "b": ColumnConfig("boolean"), "d": ColumnConfig("date")}
    draw = random.Random(5)
    made = [("abc"[: i % 3 + 1] if i > 20 else None, f"k{i % 150}", draw.choice(["($1.50)", "2,000.125 CR", "x", "€3"]), draw.choice(["$1", "4 USD", ""]), draw.choice(["yes", "no", "hm"]), draw.choice(["01/02/2023", "2023-05-17", "n/a"])) for i in range(200)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(made)], "i int, s string, k string, m string, c string, b string, d string")
    folder = f"file://{tmp_path}/parts"
    # The first part has no text in s, the last has no rows.
    for name, some in (("p0", "i <= 20"), ("p1", "i > 20 and i < 99"), ("p2", "i >= 99"), ("p3", "i < 0"), ("p1", "i >= 0")):
        increments.add_part(df.where(some), columns, folder, name, ("n/a",))
    got, want = increments.profile_of_parts(spark, columns, folder), profile.profile(df, columns, ("n/a",), approximate_unique=False)
    assert got == want
    with pytest.raises(ValueError):
        increments.add_part(df, columns, folder, "../x")
    nothing = increments.profile_of(increments.merge(increments.state(df.limit(0), columns)), columns)
    assert nothing == profile.profile(df.limit(0), columns)


def test_names_of_the_index_do_not_clash(spark):
    df = spark.createDataFrame([("a", 7, 8, 9)], "k string, _row_index int, __at int, __part int").withColumn("place", F.monotonically_increasing_id())
    assert rows.with_row_index(df.drop("place"), "n").first().asDict() == {"k": "a", "_row_index": 7, "__at": 8, "__part": 9, "n": 1}
    assert rows.indexed_by_place(df, "n", "place").first().asDict() == {"k": "a", "_row_index": 7, "__at": 8, "__part": 9, "n": 1}
    made = convert.convert(df, {"k": ColumnConfig("string")})
    assert made.columns == ["k", "_row_index", "_parse_error_count", "_parse_issues"] and made.first()._row_index == 1
    with pytest.raises(InvalidRequest):
        convert.convert(df, {"_row_index": ColumnConfig("integer")})


def test_published_buckets_are_joined_without_a_shuffle(spark, tmp_path):
    columns, options = {"k": ColumnConfig("identifier"), "n": ColumnConfig("integer")}, Options(trace_mode=("full",))
    df = spark.range(3_000).select(F.format_string("k%d", "id").alias("k"), F.when(F.col("id") % 7 == 0, "x").otherwise(F.col("id").cast("string")).alias("n"))
    made = convert.convert(df, columns, options, keep_raw=True)
    folder = f"file://{tmp_path}/it's out"
    found = sinks.publish(made, columns, options, folder, {}, [], buckets=6)
    assert len(list(Path(found["converted"].removeprefix("file://")).glob("*.parquet"))) == 6
    opened = sinks.tables(spark, folder)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("grainmill_")]
    for table, key in sinks.INDEX.items():
        numbers = lambda p: [r[key] for r in spark.read.parquet(str(p)).select(key).collect()]
        assert all(numbers(p) == sorted(numbers(p)) for p in Path(found[table].removeprefix("file://")).glob("*.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = opened["trace"].join(opened["converted"], F.col("row_index") == F.col("_row_index"))
        assert joined.count() == 6_000 and "Exchange hashpartitioning" not in plan_of(joined)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    one = opened["converted"].where("_row_index = 1235")
    query = one._jdf.queryExecution()
    assert len(query.executedPlan().executeCollectPublic()) == 1
    scanned = query.executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()
    assert [(r.k, r.n) for r in one.collect()] == [("k1234", 1234)] and 0 < scanned < 700
    # Versions without buckets beside it are opened as they are.
    sinks.publish(made.where("_row_index < 3"), columns, options, folder, {}, [])
    assert sinks.tables(spark, folder)["converted"].count() == 2 and sinks.tables(spark, folder, 1)["trace"].count() == 6_000


def plan_of(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_trace_comes_from_published_variants(spark, tmp_path):
    """Names of any kind, nulls, an empty table and long texts; in every mode it is the trace of the conversion."""
    names = ("a.b", "it's \"q`d\"", "Ünï x", "n")
    columns = {c: ColumnConfig("integer") for c in names}
    cells = [("1", " 2 ", None, "x"), ("x\"y\\", "", "n/a", "1,234"), (None, None, None, "5"), ("9" * 100_000, "1", "2", "\u2028\n")]
    for rows in (cells, cells * 40, []):
        df = spark.createDataFrame(rows, StructType([StructField(c, StringType()) for c in names]))
        options = Options(null_tokens=("n/a",), trace_mode=("full",), variants=True)
        made = convert.convert(df, columns, options, keep_raw=True)
        folder = f"file://{tmp_path}/{len(rows)}"
        sinks.publish(made, columns, options, folder, {}, [], buckets=3 if len(rows) == 4 else None)
        table = sinks.tables(spark, folder)["converted"]
        for modes in (("full",), ("issues",), ("changes",), ("issues", "changes")):
            got = trace.trace_of_published(table, columns, modes)
            assert sorted(map(repr, got.collect())) == sorted(map(repr, trace.trace(made, columns, modes).collect()))
    assert {r.code for r in table.select(F.variant_get("_parse_issues_variant", "$.n.code", "string").alias("code")).collect()} <= {None, "INVALID_INTEGER"}


def test_code_sets_are_not_in_the_plan(spark):
    """The plan of a look-up doesn't grow with its set; rows are those of a slow reading, and each stays once."""
    cells = ["fra", " DEU ", "zzz", "", None, "en", "haw", "FRA"]
    df = spark.createDataFrame([(c, c) for c in cells * 5], "code string, `other.code` string")
    columns = {c: ColumnConfig("language_code", code_format="alpha_3") for c in df.columns}
    made = convert.convert_cells(df, columns, ("n/a",))
    assert made.count() == 40 and len(made._jdf.queryExecution().toString()) < 40_000
    known = values.iso_codes("language_alpha_3")
    want = [c.strip().lower() if c and c.strip().lower() in known else None for c in cells * 5]
    for c in columns:
        rows = made.select(F.col(f"`{c}`").alias("raw"), F.col(f"`__typed__{c}`").alias("code"), F.col(f"`__issue__{c}`").alias("issue")).collect()
        assert sorted(map(str, (r.code for r in rows))) == sorted(map(str, want))
        assert all((r.issue == "INVALID_LANGUAGE_CODE") == (bool(r.raw) and r.code is None) for r in rows)
    found = profile.profile(df, columns)
    assert found["code"]["valid_count"] == found["other.code"]["valid_count"] == 20
    assert infer.infer_types(df.select("code").where("code in ('fra', 'haw', 'FRA')"), codes=True)["code"].type == "language_code"


def test_a_stream_looks_codes_up(spark, tmp_path):
    spark.createDataFrame([(" us ", "1"), ("xx", "x"), (None, "2")], "c string, n string").write.parquet(f"file://{tmp_path}/in")
    raw = spark.readStream.schema("c string, n string").parquet(f"file://{tmp_path}/in")
    made = convert_stream(raw, {"c": ColumnConfig("country_code"), "n": ColumnConfig("integer")})
    made.writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start(f"file://{tmp_path}/out").awaitTermination()
    got = {(r.c, r.n, r._parse_error_count) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == {("US", 1, 0), (None, None, 2), (None, 2, 0)}


def test_evidence_reads_each_distinct_value_once(spark):
    """Repeats count as often as they stand there, but one scan without a join finds all; three scans were joined before."""
    df = spark.createDataFrame([(v, "x") for v in ("5", " 5 ", "5", "07", "n/a", None, "soon")], "a string, b string")
    found = infer.evidence(df, ("n/a",))
    seen = {(r.column_name, r.metric): r.value for r in found.collect()}
    assert [seen["a", m] for m in ("n", "n_unique", "is_integer", "same_length")] == [5, 3, 4, 3]
    assert [seen["b", m] for m in ("n", "n_unique", "is_integer", "same_length")] == [7, 1, 0, 7]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_quality_needs_no_numbers_and_cells_are_computed_once(spark):
    """Counts take one scan without an exchange of rows; the filter of empty rows does not compute dear cells once more."""
    made = small(spark).select("k", "n", F.concat(F.reverse("d"), F.lit("")).alias("e")).withColumn("d", F.reverse("e")).drop("e")
    options = Options(null_tokens=("N/A",))
    plain = convert.convert(made, COLUMNS, options, keep_raw=True, numbered=False)
    assert "_row_index" not in plain.columns
    counts = quality.column_quality(plain, list(COLUMNS))
    numbered = quality.column_quality(convert.convert(made, COLUMNS, options, order_by=("k", "n", "d"), keep_raw=True), list(COLUMNS))
    assert sorted(counts.collect()) == sorted(numbered.collect()) and counts.first().row_count == 4
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(concat(reverse") == 1 and "RepartitionByExpression" not in plan


def test_buckets_follow_the_rows(spark, monkeypatch):
    from grainmill import queries, raw

    seen, put = [], sinks.publish
    monkeypatch.setattr(sinks, "publish", lambda *a, buckets=None, **k: seen.append(buckets) or put(*a, buckets=buckets, **k))
    df = raw.load(spark, "/root/testdata/sf0.001", "money")
    queries._published_in(df.limit(100), bucket_rows=10)
    queries._published_in(df.limit(100), bucket_rows=1000)
    assert seen == [10, 8]
