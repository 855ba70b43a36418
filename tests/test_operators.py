import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmatch.operators import gates as G
from quillmatch.operators import linkage as L
from quillmatch.operators import names as N
from quillmatch.operators import refresh as R
from quillmatch.operators import reports as P
from quillmatch.operators import sheets as S
from quillmatch.sources import io, versions


def test_latest_date_is_selected_and_lists_are_capped(spark):
    rows = [("k", "S-old", "A", "2025-01-01", 1), ("k", "S-new", "B", "2026-01-01", 2), ("k", "", "C", "2027-01-01", 3), ("none", "", "t", None, 4), ("", "x", "t", None, 5)]
    rows += [("many", f"i{i}", "t", None, 10 + i) for i in range(40)]
    df = spark.createDataFrame(rows, "key string, id string, title string, d string, n int").withColumn("d", F.to_date("d"))
    got = {r.key: r for r in L.candidate_index(df, ["key"], "id", "title", "n", ["d"]).collect()}
    assert set(got) == {"k", "none", "many"}
    k = got["k"]
    assert (k.selected_id, k.selected_title, k.ids, k.basis, k.basis_value, k.id_count, k.rows) == ("S-new", "C", "S-new | S-old", "d", "2027-01-01", 2, 3)
    assert got["none"].status == "no_match" and got["none"].basis == ""
    assert got["many"].id_count == 40 and len(got["many"]["ids"].split(" | ")) == 30 and got["many"].selected_id == "i0"


def test_mapping_keeps_every_row(spark):
    index = L.candidate_index(spark.createDataFrame([("c", "a", "1", "A", 1)], "ch string, key string, id string, title string, n int"), ["ch", "key"], "id", "title", "n")
    stmt = spark.createDataFrame([(1, "c", "a"), (2, "c", "b"), (3, "d", "a"), (4, "c", "")], "row int, ch string, key string")
    got = {r.row: r for r in L.map_statements(stmt, index, ["ch", "key"]).collect()}
    assert [got[i].ref_status for i in (1, 2, 3, 4)] == ["matched", "no_match", "no_match", "blank_key"]
    assert [got[i].review for i in (1, 2, 3, 4)] == ["N", "Y", "Y", "Y"] and got[1].master_status == "skipped"
    assert got[4].review_reason == "no key | ref cannot be matched"


def test_transfer_gate(spark):
    rows = [(1, "matched", "x", 1, "", "1,000", "700", "300"), (2, "no_match", "", 0, "", "1", "1", "1"), (3, "matched", "x", 2, "s", "a", "", "")]
    df = spark.createDataFrame(rows, "n int, ref_status string, ref_selected_id string, ref_id_count int, split_reason string, a string, b string, c string")
    got = {r.n: r for r in L.transfer_gate(df, True, "a", "b", "c").collect()}
    assert (got[1].block_reasons, got[1].sale, got[1].base, got[1].offset) == ([], 1000.0, 700.0, 300.0)
    assert got[2].block_reasons == ["not matched", "no id"]
    assert got[3].block_reasons == ["several candidates", "split reason", "sale not numeric", "base not numeric", "offset not numeric"]
    assert L.transfer_summary(L.transfer_gate(df, True, "a", "b", "c"), True).first() == (1, 2, False)
    assert L.transfer_gate(df, False, "a", "b", "c", blank_offset_as_zero=True).where("n = 1").first().block_reasons == ["amount policy not locked"]
    assert L.transfer_gate(df, True, "a", "b", "absent").first().block_reasons == ["missing columns: absent"]


def test_status_gate(spark):
    rows = [("S-OK", "C-1", "Y", "N"), ("S-MIXED", "C-1", "N", "N"), ("S-HOLD", "C-2", "N", "N"), ("S-DISABLED", "C-3", "N", "Y"), ("", "C-1", "Y", "N"), ("S-BLANK", "", "N", "N")]
    table = G.status_table(spark.createDataFrame(rows, "id string, content string, paid string, disabled string"), "id", "content", "paid", "disabled", "2026-01-01")
    assert {r.id: r.status for r in table.collect()} == {"S-OK": G.OK_EXISTS, "S-MIXED": G.HOLD_MIXED, "S-HOLD": G.HOLD_NONE, "S-DISABLED": G.BLOCK, "S-BLANK": G.HOLD_NONE}
    stmt = spark.createDataFrame([("S-OK",), ("S-HOLD",), ("new",)], "id string")
    gate = G.apply_gate(stmt, table, "id", "id")
    assert [r.id for r in gate.allowed.collect()] == ["S-OK"] and {r.gate_status for r in gate.blocked.collect()} == {G.HOLD_NONE, G.REVIEW}
    assert G.apply_gate(stmt, table, "id", "id", payment_source=True).allowed.count() == 2
    assert G.apply_gate(stmt, table, "id", "id", "audit_only").allowed.count() == 3


def test_snapshot_diff(spark):
    schema = "id string, a string, b string"
    old = spark.createDataFrame([("301", "x", "y"), ("999", "x", None), ("5", "", None)], schema)
    new = spark.createDataFrame([("301", "X", "Y"), ("777", "x", "y"), ("5", None, "")], schema)
    got = {r.id: (r.change, r.changed_fields) for r in R.snapshot_diff(old, new, "id", ["a", "b"]).collect()}
    assert got == {"301": ("modified", ["a", "b"]), "999": ("deleted", []), "777": ("added", [])}
    shaped = spark.createDataFrame([("1", "book"), ("2", "toon")], "id string, shape string")
    assert R.scope_existing(shaped, shaped.where("id = '2'"), "shape").count() == 1
    assert R.scope_existing(shaped, shaped.where("false"), "shape").count() == 2


def test_channel_detection(spark):
    words = spark.createDataFrame([("네이버_장르",), ("네이버_장르(광고수익)",), ("토스",)], "w string")
    files = spark.createDataFrame([(1, "2026년 2월 네이버_장르(광고수익) 정산상세.xlsx"), (2, "2026년 2월 카카오.xlsx")], "i int, f string")
    assert {r.i: r.found for r in N.longest_contained(files, "f", words, "w").collect()} == {1: "네이버_장르(광고수익)", 2: ""}


def test_work_order(spark):
    rows = [(1, "k", "10"), (2, "k", "20"), (3, "j", "5")]
    got = {r.key: r for r in P.work_order(spark.createDataFrame(rows, "n int, key string, row string"), ["key"], "n", ["row"]).collect()}
    assert (got["k"].group_size, got["k"].row_list, got["k"].first_no) == (2, "10 | 20", 1)


def test_workbook_to_rows(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Sale Amount</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="B2"><v>12.0</v></c></row><row r="3"><c r="B3"><v>7.5</v></c></row></sheetData><mergeCells><mergeCell ref="A2:A3"/></mergeCells></worksheet>'
    with zipfile.ZipFile(f"{tmp_path}/a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Title</t></si><si><r><t>one </t></r><r><t>book</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "b.xlsx").write_bytes(b"broken")
    cells, merges = io.scan_workbooks(spark, str(tmp_path))
    assert cells.where("error is not null").count() == 1
    cells = S.fill_merged(cells.where("error is null").select("source_file", "sheet", "row", "col", "value"), merges)
    names = spark.createDataFrame([("title", "title", 0), ("sale", "sale_amount", 0)], "field string, header string, pos int")
    got = S.standardize(cells, names).orderBy("source_row").collect()
    assert [(r.source_row, r.title, r.sale) for r in got] == [(2, "one book", "12"), (3, "one book", "7.5")]
    heads = spark.createDataFrame([("f", "s", 1, "x"), ("f", "s", 2, "x"), ("f", "s", 3, None)], "source_file string, sheet string, col int, value string")
    assert [r.name for r in S.unique_headers(heads).orderBy("col").collect()] == ["x", "x__2", "column_3"]


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "q"\nb', "x"), ("2", "", "y")], "id string, title string, kind string")
    io.write_csv(df, f"{tmp_path}/csv")
    back = io.scan_lookup(spark, f"{tmp_path}/csv", ["title", "id", "absent"])
    assert sorted(map(tuple, back.collect())) == [("", "2", ""), ('a "q"\nb', "1", "")]
    assert io.scan_lookup(spark, [], ["id"]).count() == 0
    versions.replace_table(df, f"{tmp_path}/t")
    versions.replace_table(versions.read_table(spark, f"{tmp_path}/t").where("id = '1'"), f"{tmp_path}/t")
    assert [r.id for r in versions.read_table(spark, f"{tmp_path}/t").collect()] == ["1"]
    io.write_by_class(df, "kind", f"{tmp_path}/k")
    assert spark.read.parquet(f"{tmp_path}/k/kind=x").count() == 1
    io.append_run(spark.createDataFrame([(1, "odd")], "run_id int, status string"), f"{tmp_path}/runs")
    assert spark.read.parquet(f"{tmp_path}/runs").first().status == "failed"
    paths = spark.createDataFrame([("/a/20260101/x", 2), ("/a/20260301/y", 1), ("/a/b/z", 9)], "path string, modified int")
    assert io.latest_snapshot(paths).first().path == "/a/20260301/y"
    periods = spark.createDataFrame([("x/2026-02/y", "2026-02"), ("2026년 2월", "2026-02"), ("202611_a", "2026-11"), ("3월 a", "2025-03"), ("none", "")], "p string, want string")
    assert [r.g for r in periods.select(io.period("p", 2025).alias("g")).collect()] == [r.want for r in periods.collect()]


def test_schema_clusters_gather_a_header_once(spark):
    from quillmatch.operators import reports

    rows = [(1, 3, "b"), (1, 2, "a"), (1, 1, "b"), (1, None, "c"), (2, 1, "x"), (2, 2, ""), (3, 1, None), (4, 5, "x")]
    cells = spark.createDataFrame(rows, "sheet long, pos long, header string")
    out = reports.schema_clusters(cells, "sheet", "pos", "header")
    assert [tuple(r) for r in out.orderBy("rank").collect()] == [("x", 2, 2, 1), ("", 1, 3, 2), ("c > b > a", 1, 1, 3)]
    out = reports.header_signatures(cells, "sheet", "pos", "header")  # ranks are of what this has written
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3  # headers, sheets, signatures
