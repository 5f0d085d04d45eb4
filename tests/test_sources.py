"""Landing scans, type inference, workbook reading, sinks and the run log."""

import json
import zipfile
from datetime import datetime
from xml.sax.saxutils import escape

import pytest
from pyspark.sql import functions as F

from ebbmark.sources import infer, readers, runlog, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def types(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def test_csv_types_are_inferred_and_dates_stay_text(spark, tmp_path):
    path = tmp_path / "Orders.CSV"
    path.write_text("order_id,day,n,x,ok,gap\nO1,2025-01-01,1,1.5,True,NA\nO2,01/02/2025,2,,false,\n")
    df = readers.read_any(spark, str(path))
    assert types(df) == {"order_id": "string", "day": "string", "n": "bigint", "x": "double", "ok": "boolean", "gap": "double"}
    assert rows(df) == [("O1", "2025-01-01", 1, 1.5, True, None), ("O2", "01/02/2025", 2, None, False, None)]


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "notes.csv"
    path.write_text('id,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    assert rows(readers.read_csv(spark, str(path))) == [(1, 'two\nlines, "quoted"'), (2, "plain")]


def test_csv_without_line_breaks_in_records_is_splittable(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,note\n1,"a, ""b"""\n')
    df = readers.read_csv(spark, str(path))
    assert rows(df) == [(1, 'a, "b"')]
    assert "multiline" not in df._jdf.queryExecution().logical().toString().lower()


def test_infer_types_whole_column_decides(spark):
    df = spark.createDataFrame([("1", "1", "1e400", "x"), ("2", "1.5", "2", None), ("99999999999999999999", "N/A", "3", "None")], "a string, b string, c string, d string")
    assert types(infer.infer_types(df)) == {"a": "double", "b": "double", "c": "string", "d": "string"}


@pytest.mark.parametrize("document", [
    [{"a": 1, "b": "x"}, {"a": 2, "b": None}],
    {"data": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]},
    {"data": 7, "records": [{"a": 1, "b": "x"}, {"a": 2, "b": None}], "items": [{"z": 1}]},
    {"meta": {"n": 2}, "items": [{"a": 1, "b": "x"}, {"a": 2, "b": None}]},
])
def test_json_list_and_envelopes(spark, tmp_path, document):
    path = tmp_path / "returns.json"
    path.write_text(json.dumps(document, indent=1))
    assert rows(readers.read_any(spark, str(path)).select("a", "b")) == [(1, "x"), (2, None)]


def test_json_single_object_and_nested_columns(spark, tmp_path):
    path = tmp_path / "one.json"
    path.write_text(json.dumps({"id": 1, "who": {"name": "n", "at": {"city": "c"}}, "tags": [1, 2]}))
    df = readers.read_json(spark, str(path))
    assert sorted(df.columns) == ["id", "tags", "who.at.city", "who.name"]
    row = df.first()
    assert (row["who.at.city"], row["who.name"], row["tags"]) == ("c", "n", [1, 2])


def test_json_list_of_records_with_a_data_field_is_not_unwrapped(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text(json.dumps([{"k": 1, "data": [{"a": 1}]}]))
    assert sorted(readers.read_json(spark, str(path)).columns) == ["data", "k"]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('{"a": 1}\n{"a": 2}\n')
    assert rows(readers.read_json(spark, str(path), lines=True)) == [(1,), (2,)]


def test_json_folder_of_mixed_shapes_keeps_every_row(spark, tmp_path):
    folder = tmp_path / "in.json"
    folder.mkdir()
    documents = {"a": {"data": [{"k": 1}, {"k": 2}]}, "b": [{"k": 3}, {"k": 4}], "c": {"records": [{"k": 5}, {"k": 6}]}, "d": {"k": 7}}
    for name, document in documents.items():
        (folder / f"{name}.json").write_text(json.dumps(document, indent=2))
    (folder / "e.json").write_text('{"k": 8}\n{"k": 9, "more": "x"}\n')
    df = readers.read_any(spark, str(folder))
    assert sorted(r.k for r in df.collect()) == list(range(1, 10))
    assert df.where("more = 'x'").count() == 1


def test_json_lines_are_found(spark, tmp_path):
    path = tmp_path / "lines.json"
    path.write_text('{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert rows(readers.read_any(spark, str(path))) == [(1,), (2,), (3,)]


def test_unknown_suffix_is_an_error(spark):
    with pytest.raises(ValueError, match=r"\.txt.*\.csv"):
        readers.read_any(spark, "/nowhere/a.txt")
    assert readers.file_format("/x/Orders.XLSX") == "xlsx"


def write_workbook(path, table, date_columns=()):
    """A minimal workbook: shared strings, one date style, a blank row."""
    strings, cells = [], []
    for r, line in enumerate(table, 1):
        out = []
        for c, value in enumerate(line):
            ref = f"{chr(65 + c)}{r}"
            if value is None:
                continue
            if isinstance(value, bool):
                out.append(f'<c r="{ref}" t="b"><v>{int(value)}</v></c>')
            elif isinstance(value, datetime):
                days = (value - datetime(1899, 12, 30)).total_seconds() / 86400
                out.append(f'<c r="{ref}" s="1"><v>{days!r}</v></c>')
            elif isinstance(value, (int, float)):
                out.append(f'<c r="{ref}"><v>{value}</v></c>')
            else:
                strings.append(value)
                out.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
        cells.append(f'<row r="{r}">{"".join(out)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    parts = {
        "xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="S" sheetId="1" r:id="rId7"/><sheet name="T" sheetId="2" r:id="rId8"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="t" Target="worksheets/first.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst {ns}>' + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>",
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/first.xml": f'<worksheet {ns}><sheetData>{"".join(cells)}</sheetData></worksheet>',
    }
    with zipfile.ZipFile(path, "w") as book:
        for name, content in parts.items():
            book.writestr(name, content)


def test_workbook(spark, tmp_path):
    path = tmp_path / "products.xlsx"
    write_workbook(path, [
        ["product_id", "cost_price", "launch_date", "active", "name", "n"],
        ["P1", 9.5, datetime(2024, 3, 1), True, "a & b", 1],
        [None, None, None, None, None, None],
        ["P2", 10, datetime(2024, 3, 2, 12, 30), False, None, 2],
    ])
    df = readers.read_any(spark, str(path))
    assert types(df) == {"product_id": "string", "cost_price": "double", "launch_date": "timestamp", "active": "boolean", "name": "string", "n": "bigint"}
    assert rows(df) == [("P1", 9.5, datetime(2024, 3, 1), True, "a & b", 1), ("P2", 10.0, datetime(2024, 3, 2, 12, 30), False, None, 2)]


def test_workbooks_of_one_folder_share_a_header(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", [["k", "v"], ["x", 1]])
    write_workbook(tmp_path / "b.xlsx", [["k", "v"], ["y", 2]])
    assert rows(readers.read_any(spark, str(tmp_path), "xlsx")) == [("x", 1), ("y", 2)]
    write_workbook(tmp_path / "c.xlsx", [["v", "k"], [3, "z"]])
    with pytest.raises(ValueError, match="different headers"):
        readers.read_any(spark, str(tmp_path), "xlsx")


def test_layer_write_overwrites_and_is_scoped_by_run(spark, tmp_path):
    root = str(tmp_path)
    sinks.write_layer(spark.range(3).toDF("a"), root, "r1", "silver", "orders")
    out = sinks.write_layer(spark.range(2).toDF("a"), root, "r1", "silver", "orders")
    other = sinks.write_layer(spark.range(5).toDF("a"), root, "r2", "silver", "orders")
    assert (out.count(), other.count()) == (2, 5)
    assert spark.read.parquet(f"{root}/r1/silver/orders_silver").count() == 2


def test_records_keep_null_fields_and_stop_at_the_limit(spark):
    df = spark.range(500).select("id", F.lit(None).cast("string").alias("gap"))
    out = sinks.records(df).collect()
    assert len(out) == 200 and set(json.loads(out[0].record)) == {"id", "gap"}


def test_profile_and_report_files(spark, tmp_path):
    path = sinks.write_profile(spark.range(2).toDF("n"), str(tmp_path), "r1", "now")
    assert {(r.run_id, r.generated_at) for r in spark.read.json(path).collect()} == {("r1", "now")}
    path = sinks.write_report(spark.range(1).toDF("n"), {"direct_answer": "x"}, str(tmp_path), "r1")
    assert spark.read.json(f"{path}/analysis").first().content == "x"
    assert spark.read.json(f"{path}/forecast").count() == 1


def test_run_log_round_trip(spark, tmp_path):
    log = str(tmp_path / "log")
    assert runlog.read_log(spark, log, "r1").count() == 0
    runlog.log_event(spark, log, "r1", "bronze", "table_written", rows=3, note=None)
    runlog.log_event(spark, log, "r2", "gold", "done")
    got = runlog.read_log(spark, log, "r1").collect()
    assert [(r.agent, r.action, r.details["rows"], r.run_id) for r in got] == [("bronze", "table_written", "3", "r1")]
    assert runlog.read_log(spark, log, "r3").count() == 0
    both = runlog.read_log(spark, log, "r1").unionByName(runlog.read_log(spark, log, "r2"))
    assert [r.run_id for r in runlog.recent_events(both).collect()] == ["r2", "r1"]


def test_observed_rows_come_from_the_write_itself(spark, tmp_path):
    df, seen = runlog.observe_rows(spark.range(7).toDF("n"), "obs", top=F.max("n"))
    df.write.parquet(str(tmp_path / "t"))
    assert seen.get == {"rows": 7, "top": 6}


def test_json_list_behind_a_long_blank_run(spark, tmp_path):
    (tmp_path / "late.json").write_text(" " * 9_000 + "\n" + '[{"data": [{"a": 1}]},\n{"data": [{"a": 2}]}]')
    assert sorted(r.data[0].a for r in readers.read_json(spark, str(tmp_path / "late.json")).collect()) == [1, 2]
