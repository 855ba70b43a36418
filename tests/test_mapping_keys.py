"""Mapping joins an index's lists with the distinct keys of the statements, not with their rows."""

import re

from quillmatch.operators import linkage as L

ON = ["c", "clean_key"]


def _index(spark):
    rows = spark.createDataFrame([("a", "x", "1", "X", 1), ("a", "x", "2", "XX", 2), ("b", "y", "3", "Y", 3)], "c string, clean_key string, id string, title string, n int")
    return L.candidate_index(rows, ON, "id", "title", "n"), L.candidate_index(rows, ["clean_key"], "id", "title", "n")


def test_rows_of_all_kinds_of_keys(spark):
    ref, master = _index(spark)
    stmt = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, None, "y"), (5, "a", ""), (6, "a", None), (7, None, None), (7, None, None)], "i int, c string, clean_key string")
    for clustered in (False, True):
        out = L.map_statements(stmt, ref, ON, master, clustered=clustered)
        assert out.columns[:3] == ["i", "c", "clean_key"] and out.columns[-2:] == ["review_reason", "review"]
        got = sorted((r.i, r.ref_status, r.ref_ids, r.master_status, r.review) for r in out.collect())
        blank = [(i, "blank_key", "", "blank_key", "Y") for i in (5, 6, 7, 7)]
        assert got == [(1, "matched", "1 | 2", "matched", "N"), (2, "matched", "1 | 2", "matched", "N"), (3, "no_match", "", "matched", "Y"), (4, "no_match", "", "matched", "Y"), *blank]


def test_statement_rows_are_joined_once(spark):
    """Only distinct keys meet the lists: no join of the statements' rows carries one index's lists to the other's."""
    ref, master = _index(spark)
    plan = L.map_statements(spark.range(9).selectExpr("id as i", "'a' as c", "'x' as clean_key"), ref, ON, master)._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in re.findall(r"Join (\w+)", plan)][0] == "Inner" and "Aggregate [c" in plan.split("Join Inner", 1)[1]
