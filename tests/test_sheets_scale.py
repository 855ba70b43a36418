"""Sheets at scale: cells move once, tasks stay of one size, tables of a few rows need no Python and are broadcast."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import sheets as S
from quillmatch.plans.linkage import few
from quillmatch.sources.scratch import dealt

CELL = "source_file string, sheet string, row int, col int, value string"
NAMES = [("title", "Title", 0), ("title", "Name", 1), ("author", "Author", 0), ("sale", "Sale", 0)]


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def names(spark):
    return few(spark, NAMES, "field string, header string, pos int")


def test_cells_dealt_out_by_sheet_do_not_move(spark):
    """Before, standardize() shuffled the cells for each of its joins, and sections() too."""
    rows = [("f", f"s{i % 7}", r, c, v) for i in range(7) for r, vs in enumerate([("Title", "Sale"), ("a", "1"), ("b", "2")], 1) for c, v in enumerate(vs, 1)]
    cells = spark.createDataFrame(rows, CELL).repartition(3, *S.SHEET)
    for made in (S.standardize(cells, names(spark), repeated=True), S.standardize(cells, names(spark)), S.sections(cells, names(spark))):
        found = plan(made)
        assert "SortMergeJoin" not in found
        moved = [x for x in found.split("== Initial Plan ==")[0].split("\n") if "Exchange hashpartitioning" in x and "sheet" in x]
        assert moved and all("REPARTITION_BY_NUM" in x for x in moved), moved


def test_tasks_grow_with_the_table(spark):
    parts = lambda n: dealt(spark.range(n), ["id"], each=100).rdd.getNumPartitions()
    assert parts(10) == spark.sparkContext.defaultParallelism and parts(4_000) == 40


def test_few_rows_are_made_without_python(spark):
    made = few(spark, [("a", None, 1), ("it's", "b", 2)], "x string, y string, n int")
    assert sorted(map(tuple, made.collect())) == [("a", None, 1), ("it's", "b", 2)]
    big = spark.range(100).withColumn("x", F.col("id").cast("string"))
    assert "BroadcastHashJoin" in plan(big.join(made, "x")) and "ExistingRDD" not in plan(made)


def test_headers_of_odd_sheets(spark):
    """Rows without a sheet, blank cells, gaps, a header that two columns hold, sections whose columns change places."""
    rows = [
        ("f", None, 1, 1, "Title"), ("f", "s", 1, 1, "banner"), ("f", "s", 2, 1, "Name"), ("f", "s", 2, 2, "Title"), ("f", "s", 2, 3, "Title"), ("f", "s", 2, 4, " Sa-le "),
        ("f", "s", 3, 1, "n"), ("f", "s", 3, 2, "t1"), ("f", "s", 3, 3, "t2"), ("f", "s", 3, 4, None), ("f", "s", 5, 9, "elsewhere"), ("f", "s", 6, 1, "Sale"), ("f", "s", 6, 2, "Title"), ("f", "s", 6, 3, ""),
        ("f", "s", 7, 1, "7"), ("f", "s", 7, 2, "t3"), ("f", "none", 1, 1, "Sale"), ("f", "none", 2, 1, "x"),
    ]
    cells = spark.createDataFrame(rows, CELL)
    several = S.standardize(cells, names(spark), ("title", "sale"), repeated=True).collect()
    assert sorted(map(tuple, several)) == [("f", "s", 3, "t1", ""), ("f", "s", 7, "t3", "7")]
    one = S.standardize(cells, names(spark), ("title", "sale")).collect()
    assert sorted(map(tuple, one)) == [("f", "s", 3, "t1", ""), ("f", "s", 6, "Title", ""), ("f", "s", 7, "t3", "")]
    below = S.sections(cells, names(spark)).select("row", "col", "header_row").collect()
    assert sorted(map(tuple, below)) == [(3, 1, 2), (3, 2, 2), (3, 3, 2), (3, 4, 2), (5, 9, 2), (7, 1, 6), (7, 2, 6)]
