import os
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmatch.sources import io, reference, versions
from quillmatch.sources import workbooks as W


def books(spark, path, files=3, sheets=3):
    rows = [(f"f{i}.xlsx", f"s{j}", r, c, None if (r, c) == (2, 2) else f"v{i}{j}\x01<&>é {r}" if c > 1 else f"{r}.0", "text" if c > 1 else "number") for i in range(files) for j in range(sheets) for r in (1, 2, 5) for c in (1, 2, 28)]
    df = spark.createDataFrame(rows, "source_file string, sheet string, row int, col int, value string, value_type string")
    W.write_workbooks(df, path)
    return [(f, s, r, c, v.replace("\x01", "�").removesuffix(".0"), k) for f, s, r, c, v, k in rows if v is not None]


def plain(df):
    return sorted((r.source_file.split("/")[-1], r.sheet, r.row, r.col, r.value, r.value_type) for r in df.collect())


def test_workbooks_round_trip_and_a_partition_a_sheet(spark, tmp_path):
    path = f"{tmp_path}/books"
    rows = books(spark, path)
    df = W.read_workbooks(spark, path)
    assert plain(df) == sorted(rows) and df.rdd.getNumPartitions() == 9
    assert sorted(os.listdir(path)) == ["f0.xlsx", "f1.xlsx", "f2.xlsx"]  # nothing unfinished is left
    cells, merges = io.scan_workbooks(spark, path)
    assert plain(cells.drop("error")) == sorted(rows) and merges.count() == 0
    assert W.read_workbooks(spark, f"{tmp_path}/none").count() == 0


def spoiled(path, sheet):
    """The workbook with a sheet's XML cut off."""
    with zipfile.ZipFile(path) as z:
        parts = {n: z.read(n) for n in z.namelist()}
    with zipfile.ZipFile(path, "w") as z:
        for n, data in parts.items():
            z.writestr(n, data[:-30] if n.endswith(f"sheet{sheet}.xml") else data)


def test_other_sheets_are_not_parsed(spark, tmp_path):
    path = f"{tmp_path}/books"
    rows = books(spark, path, 2)
    spoiled(f"{path}/f0.xlsx", 2)
    with open(f"{path}/bad.xlsx", "w") as f:
        f.write("no workbook")
    every = W.read_workbooks(spark, path)
    errors = [(r.source_file.split("/")[-1], r.sheet, r.error.split(":")[0]) for r in every.where("error is not null").collect()]
    assert sorted(errors, key=str) == [("bad.xlsx", None, "BadZipFile"), ("f0.xlsx", "s1", "ParseError")] or {e[:2] for e in errors} == {("bad.xlsx", None), ("f0.xlsx", "s1")}
    one = W.read_workbooks(spark, path, sheet="s0")
    assert plain(one) == sorted(r for r in rows if r[1] == "s0") and one.rdd.getNumPartitions() == 2
    try:
        spark.conf.set(W.PUSHDOWN, "true")
        some = W.read_workbooks(spark, path).where(F.col("sheet").isin("s0", "s2"))
        assert some.rdd.getNumPartitions() == 4 and plain(some) == sorted(r for r in rows if r[1] != "s1")
        assert W.read_workbooks(spark, path).where(F.col("source_file") == f"{path}/f1.xlsx").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset(W.PUSHDOWN)


def test_two_writers_of_one_version(spark, tmp_path):
    path = f"{tmp_path}/t"
    ids = lambda df: sorted(r.id for r in df.collect())
    with pytest.raises(ValueError, match="no version"):
        versions.read_table(spark, path)
    first = versions.replace_table(spark.range(5), path, based_on=0)
    assert versions.replace_table(spark.range(7), path, based_on=first) == 2
    with pytest.raises(versions.Conflict):
        versions.replace_table(spark.range(9), path, based_on=first)
    assert ids(versions.read_table(spark, path)) == list(range(7)) and ids(versions.read_table(spark, path, first)) == list(range(5))
    assert not versions.commit(spark, path, 2, ["data/x"]) and versions.versions(spark, path) == [1, 2]
    assert len(os.listdir(f"{path}/data")) == 2 and not [f for f in os.listdir(f"{path}/_commits") if f.startswith(".") and not f.endswith(".crc")]
    made = []
    threads = [threading.Thread(target=lambda lo=lo: made.append(versions.append_table(spark.range(lo, lo + 3), path))) for lo in (100, 200, 300)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(made) == [3, 4, 5] and ids(versions.read_table(spark, path)) == [*range(7), 100, 101, 102, 200, 201, 202, 300, 301, 302]


def test_old_versions_go_and_shared_data_stay(spark, tmp_path):
    path = f"{tmp_path}/t"
    for n in (1, 2):
        versions.replace_table(spark.range(n), path)
    versions.append_table(spark.range(10, 12), path)
    assert versions.remove_old(spark, path, keep=1) == [1, 2] and versions.versions(spark, path) == [3]
    assert sorted(r.id for r in versions.read_table(spark, path).collect()) == [0, 1, 10, 11]
    assert len(os.listdir(f"{path}/data")) == 2 and versions.replace_table(spark.range(1), path) == 4
    with pytest.raises(ValueError, match="no version 1"):
        versions.read_table(spark, path, 1)


def test_only_touched_reports_are_written_again(spark, tmp_path):
    path = f"{tmp_path}/r"
    rows = spark.createDataFrame([("a b", 1), ("c/d", 2), ("e", 3), ("e", 4)], "ch string, n int")
    io.write_reports(rows, "ch", path)
    files = lambda: {d: sorted(os.listdir(f"{path}/{d}")) for d in os.listdir(path) if d.startswith("ch=")}
    before = files()
    touched = spark.createDataFrame([("e",), ("c/d",)], "ch string")
    new = spark.createDataFrame([("e", 30), ("a b", 99)], "ch string, n int")
    io.rewrite_reports(new, touched, "ch", path, spark.createDataFrame([("e", "why")], "ch string, added string"))
    after = files()
    assert after["ch=a b"] == before["ch=a b"] and after["ch=e"] != before["ch=e"] and len(after) == 2
    assert sorted((r.ch, r.n) for r in spark.read.parquet(path).collect()) == [("a b", 1), ("e", 30)]
    assert spark.read.parquet(f"{path}-lineage").count() == 1


def test_an_index_table_is_joined_where_it_lies(spark):
    rows = spark.createDataFrame([(f"c{i % 3}", f"title {chr(97 + i % 20)} {i % 7}화", str(i), i) for i in range(500)] + [("c0", "gone (사용안함)", "x", 999)], "ch string, title string, id string, no int")
    index = reference.build_reference(rows, ["ch", "key"], "id", "title", "no")
    held = reference.index_table(index, ["ch", "key"], 4)
    assert sorted(held.collect(), key=str) == sorted(index.collect(), key=str) and held.where("key like 'gone%'").count() == 0
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        stmt = spark.range(100).selectExpr("concat('c', id % 3) ch", "concat('title', char(97 + id % 20)) key")
        joined = stmt.join(held, ["ch", "key"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and joined.count() == 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert reference.drop_indexes(spark)
