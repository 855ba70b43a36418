import random

import pytest
from pyspark.sql import functions as F

from quillmatch.operators import linkage as L
from quillmatch.operators import ranks, tops
from quillmatch.operators import refresh as R
from quillmatch.operators import sheets as S
from quillmatch.sources import io, versions


def test_global_rank_without_one_task(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1.5, 2.5]), i, "x") for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, i int, part string")
    out = ranks.global_rank(df, [F.desc_nulls_last("v"), F.col("i")], "r")
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString() and out.columns == ["v", "i", "part", "r"]
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.i, r.part) for r in sorted(out.collect(), key=lambda r: r.r)] == want and sorted(r.r for r in out.collect()) == list(range(1, 3001))
    assert ranks.global_rank(df.limit(0), [F.col("i")]).count() == 0


def test_parts_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a,\"{i}\"\nb") for i in range(1000)], "i int, t string").repartition(7)
    ranks.write_ordered(df, [F.desc("i")], f"{tmp_path}/p", 300)
    got = ranks.read_ordered(spark, f"{tmp_path}/p").orderBy("file_no", "row_no").collect()
    assert [(int(r.i), r.t) for r in got] == [(i, f"a,\"{i}\"\nb") for i in range(999, -1, -1)]
    assert [(r.file_no, r.row_no) for r in got if r.row_no == 1] == [(1, 1), (2, 1), (3, 1), (4, 1)]


@pytest.mark.parametrize("tracked", [64, 4096])
def test_top_values_are_exact(spark, tracked):
    """A skewed column that the sketch settles, flat and tied ones that it can't, blanks, a column of one value."""
    rng = random.Random(1)
    rows = [(f"w{int(rng.paretovariate(0.7))}", f"id{i}", f"t{i % 40}", None if i % 3 else " ", 1) for i in range(6000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, n int")
    got = {(r["column"], r["place"]): (r["value"], r["n"]) for r in tops.top_values(df, ["a", "b", "c", "d", "n"], 10, tracked).collect()}
    want = {}
    for j, c in enumerate("abcdn"):
        seen = {}
        for r in rows:
            v = str(r[j] if r[j] is not None else "").strip() or "(blank)"
            seen[v] = seen.get(v, 0) + 1
        for p, (v, n) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[c, p] = (v, n)
    assert got == want
    assert tops.top_values(df.limit(0), ["a", "b"]).count() == 0


def test_a_mapping_run_makes_its_rows_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def touch(it):
        for pdf in it:
            made.add(len(pdf))
            yield pdf

    stmt = spark.createDataFrame([("A", "k1", 1), ("A", "", 2), ("A", "k9", 3)], "ch string, key string, no int")
    index = L.candidate_index(spark.createDataFrame([("A", "k1", "7", "t", 1), ("A", "k1", "8", "t", 2)], "ch string, key string, id string, title string, no int"), ["ch", "key"], "id", "title", "no")
    rows = L.map_statements(stmt, index, ["ch", "key"]).mapInPandas(touch, L.map_statements(stmt, index, ["ch", "key"]).schema)
    dup = L.duplicates(index, stmt, ["ch", "key"])
    out = io.write_mapping_run(rows, dup, spark.createDataFrame([("x", "1")], "item string, value string"), f"{tmp_path}/run")
    assert made.value == 3
    want = L.mapping_summary(L.map_statements(stmt, index, ["ch", "key"]), dup)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(f"{tmp_path}/run/review").count() == 2


def test_a_refresh_is_logged_and_never_based_on_a_stale_version(spark, tmp_path, monkeypatch):
    path, log = f"{tmp_path}/t", f"{tmp_path}/log"
    frame = lambda rows: spark.createDataFrame(rows, "id string, day string, title string, n int")
    refresh = lambda rows, run, **kw: R.replace_lookup(frame(rows), path, log, run, "id", "day", ["n"], "title", [], **kw)
    assert refresh([("1", "2020-01-01", "a", 1), ("2", "2020-01-01", "b", 2)], "r1") == 1
    assert refresh([("1", "2020-01-02", "a2", 1), ("3", "2020-01-01", "c", 2)], "r2") == 2
    with pytest.raises(ValueError, match="whole"):
        refresh([], "r3", mode="merge")
    made = R.refresh_lookup
    monkeypatch.setattr(R, "refresh_lookup", lambda *a: (versions.replace_table(frame([("9", "2020", "z", 1)]), path), made(*a))[1])
    with pytest.raises(versions.Conflict):
        refresh([("1", "2020-01-03", "a3", 1)], "r4")
    runs = {r.run_id: (r.status, r.version, r.added, r.deleted, r.modified) for r in spark.read.parquet(f"{log}/runs").collect()}
    assert runs == {"r1": ("success", 1, 2, 0, 0), "r2": ("success", 2, 1, 1, 1), "r3": ("failed", None, None, None, None), "r4": ("failed", None, None, None, None)}
    assert [r.id for r in versions.read_table(spark, path).collect()] == ["9"] and spark.read.parquet(f"{log}/changes").count() == 5
    io.append_changes(spark.createDataFrame([("5", "added"), ("6", "odd")], "id string, change string"), f"{tmp_path}/c", F.lit("r"))
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/c").collect()] == ["5"]


def test_normalised_statements_and_their_audit(spark):
    head = ["Title", "ＩＳＢＮ", "Sale"]
    sheet = lambda f, s, rows, top=1: [(f, s, r, c, v, "text", None) for r, row in enumerate(rows, top) for c, v in enumerate(row, 1) if v is not None]
    cells = sheet("a.xlsx", "ok", [["Banner"], head, ["x 1화", "111", "1,000원"], [None, "112", "5"], ["total", None, "5"]])
    cells += sheet("a.xlsx", "empty", [head]) + sheet("a.xlsx", "odd", [["nothing"]]) + sheet("a.xlsx", "memo", [head, ["y", "1", "2"]])
    cells += sheet("b.xlsx", "s", [head, ["p", "1", "2"], head, ["q", "3", "4"]]) + sheet("c.xlsx", "s", [head, ["z", "1", "2"]])
    cells += [("a.xlsx", "torn", 0, 0, None, "error", "ParseError")]
    df = spark.createDataFrame(cells, "source_file string, sheet string, row int, col int, value string, value_type string, error string")
    merges = spark.createDataFrame([("a.xlsx", "ok", 3, 1, 4, 1)], "source_file string, sheet string, min_row int, min_col int, max_row int, max_col int")
    files = spark.createDataFrame([("a.xlsx", "A", "include"), ("b.xlsx", "B", "include"), ("c.xlsx", "A", "excluded_by_rule")], "source_file string, platform string, file_status string")
    registry = spark.createDataFrame([("A", "Title", "없음", "isbn", "sale", "single", "locked", "open"), ("B", "title", "없음", "ISBN", "Sale", S.REPEATED, "c", "d")], "platform string, title_from string, author_from string, external_id_from string, sale_from string, parser_contract string, amount_rule_status string, s2_gate string")
    scope = spark.createDataFrame([("A", None, "^memo$")], "platform string, wanted string, unwanted string")
    blocked = spark.createDataFrame([("A", "isbn")], "platform string, word string")
    rows, audit = S.normalize_statements(df, merges, files, registry, scope, blocked=blocked, exact=["total"])
    got = sorted((r.source_file, r.source_row, r.title, r.external_id, r.sale, r.clean_key) for r in rows.collect())
    assert got == [("a.xlsx", 3, "x 1화", "", "1,000원", "x"), ("a.xlsx", 4, "x 1화", "", "5", "x"), ("b.xlsx", 2, "p", "1", "2", "p"), ("b.xlsx", 4, "q", "3", "4", "q")]
    seen = {(r.source_file, r.sheet): (r.status, r.header_row, r.parsed_rows) for r in audit.collect()}
    assert seen == {
        ("a.xlsx", "ok"): ("parsed", 2, 2), ("a.xlsx", "empty"): ("no_data", 1, 0), ("a.xlsx", "odd"): ("header_not_found", None, 0), ("a.xlsx", "memo"): ("excluded_sheet", None, 0),
        ("a.xlsx", "torn"): ("unreadable", None, 0), ("b.xlsx", "s"): ("parsed", 1, 2), ("c.xlsx", "s"): ("excluded_by_rule", None, 0),
    }
