import datetime

import pytest
from pyspark.sql import functions as F

from quillmatch.functions import text as T
from quillmatch.functions.titles import add_clean_key
from quillmatch.operators import gates as G
from quillmatch.operators import linkage as L
from quillmatch.operators import names
from quillmatch.operators import reports as P
from quillmatch.operators.sheets import header_key
from quillmatch.sources import io


def test_missing_numbers(spark):
    df = spark.createDataFrame([(1.0, "NaN"), (float("nan"), " x "), (None, None)], "d double, s string")
    assert [tuple(r) for r in T.text_frame(df).collect()] == [("1.0", "NaN"), ("", "x"), ("", "")] and T.text_frame(df).columns == ["d", "s"]
    rows = spark.createDataFrame([("1,200.0",), ("1.50",), ("x",), (None,), ("-3",)], "c string")
    assert [r.v for r in rows.select(T.normalize_number("c").alias("v")).collect()] == ["1200", "1.5", "", "", "-3"]


def test_full_width_tags_headers_and_dates(spark):
    df = spark.createDataFrame([("[１９금]",), ("[ＢＬ]",), ("[효종]",)], "t string")
    assert [r.clean_key for r in add_clean_key(df, "t").collect()] == ["", "", "효종"]
    assert [r.h for r in df.limit(1).select(header_key(F.lit("（Ｓａｌｅ）　금액")).alias("h")).collect()] == ["sale금액"]
    days = spark.createDataFrame([(datetime.date(2026, 7, 24),), (None,)], "t date")
    assert [r.clean_key for r in add_clean_key(days, "t").collect()] == ["7월24일", ""]


def test_lookups_that_are_not_there(spark, tmp_path):
    assert io.scan_lookup(spark, f"{tmp_path}/no.csv", ["a", "b"]).columns == ["a", "b"] and io.scan_lookup(spark, f"{tmp_path}/no.csv", ["a"]).count() == 0
    (tmp_path / "t.csv").write_text("a,c\n9,9\n")
    assert [tuple(r) for r in io.scan_parts(spark, str(tmp_path), "t", ["a", "b"]).collect()] == [("9", "")]
    for i in (1, 2):
        (tmp_path / f"t_part_{i}.csv").write_text(f"a,b\n{i},x\n")
    assert sorted(r.a for r in io.scan_parts(spark, str(tmp_path), "t", ["a", "b"]).collect()) == ["1", "2"]


def test_payment_layouts(spark):
    raw = spark.createDataFrame([("1", "2", "3", "4", "5", "kept")], "schnCtnsId string, ctnsId string, ctnsNm string, pymtSetlId string, pymtSetlDtlId string, title string")
    names_ = {"schnCtnsId": "id", "ctnsNm": "title"}
    assert [(r.id, r.title) for r in io.payment_rows(raw, names_, ["id", "title"]).collect()] == [("1", "kept")]
    assert io.payment_rows(raw, names_, ["ctnsId"]).columns == raw.columns
    with pytest.raises(ValueError, match="id, other"):
        io.payment_rows(raw.drop("pymtSetlId"), names_, ["id", "other", "title"])


def test_gate_warnings(spark):
    rows, table = spark.createDataFrame([("1",), ("2",), ("3",)], "id string"), spark.createDataFrame([("1", G.OK_EXISTS), ("2", G.BLOCK)], "id string, status string")
    said = {m: [tuple(r) for r in G.gate_warnings(G.apply_gate(rows, table, "id", "id", m), m).collect()] for m in ("strict", "audit_only")}
    assert [n for _, n in said["strict"]] == [2] and [n for _, n in said["audit_only"]] == [2] and said["strict"] != said["audit_only"]
    assert G.gate_warnings(G.apply_gate(rows.where("id = 1"), table, "id", "id"), "strict").count() == 0


def test_coverage_judgement(spark):
    service = spark.createDataFrame([("1", "k1", "N", "A"), ("2", "k2", "N", "A"), ("3", "k3", "N", "B"), ("4", "k1", "Y", None)], "id string, key string, off string, ch string")
    lookup = spark.createDataFrame([("1", "first", 1), ("1", "second", 2)], "id string, title string, no int")
    samples = spark.createDataFrame([("k2", "f.xlsx"), ("k1", "g.xlsx")], "key string, file string")
    out = P.coverage_judgement(service, lookup, samples, "id", "key", "file", "off", "no", ["title"])
    got = {r.id: (r.grade, r.in_samples, r.paid_title, r.action == P.GRADE_ACTIONS[r.grade]) for r in out.collect()}
    assert got == {"1": ("OK_PAID", "Y", "first", True), "2": ("A_SEEN_WITHOUT_PAYMENT", "Y", "", True), "3": ("B_WITHOUT_PAYMENT", "N", "", True), "4": ("C_DISABLED", "Y", "", True)}
    counts = {(r.ch, r.total, r.grade): r.n for r in P.coverage_summary(out, "ch").collect()}
    assert counts["A", False, "OK_PAID"] == 1 and counts["", False, "C_DISABLED"] == 1 and sum(n for (_, t, _), n in counts.items() if t) == 4


def test_guard_counts_exclude_candidates(spark):
    rows = spark.createDataFrame([("r", "A", "id=7", "0"), ("r", "A", "id=7", "2"), ("r", "A", "id=8", ""), ("other", "A", "id=7", "")], "detail_reason string, ch string, detail_evidence string, hits string")
    out = P.safe_candidates(rows, "r", spark.createDataFrame([("7",)], "m string"), [], "ch", counts=["hits", "absent"])
    assert sorted((r.detail_evidence, r.hits, r.excluded_because) for r in out.collect()) == [("id=7", "0", ""), ("id=7", "2", "hits=2"), ("id=8", "", "not in master")]


def test_source_columns_and_duplicates_of_two_sides(spark):
    df = spark.createDataFrame([(1, "k", "x", "matched")], "no int, clean_key string, `odd name` string, ref_status string")
    assert L.with_source_columns(df, "src_", ["no"]).columns == ["no", "clean_key", "ref_status", "src_odd name"]
    both = L.all_duplicates({"ref": spark.createDataFrame([("A", "k", 2)], "ch string, key string, n int"), "master": spark.createDataFrame([("k", 3)], "key string, n int")})
    assert sorted((r.reference, r.ch, r.key, r.n) for r in both.collect()) == [("master", None, "k", 3), ("ref", "A", "k", 2)]


def test_names_by_blocks_and_ties(spark):
    import random

    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(400)})
    files = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 12))) for _ in range(300)] + ["", None, "dddd"]
    want = [max((w for w in words if f and w in f), key=lambda w: (len(w), [-ord(c) for c in w]), default="") for f in files]
    df, table = spark.createDataFrame(list(enumerate(files)), "i int, f string"), spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "w string")
    for block in (1 << 20, 37):
        got = {r.i: r.found for r in names.longest_contained(df, "f", table, "w", block=block).collect()}
        assert [got[i] for i in range(len(files))] == want
    many = spark.range(10_000).selectExpr("concat('w', id) w")
    assert names.longest_contained(spark.createDataFrame([("xw9999y",)], "f string"), "f", many, "w").first().found == "w9999"
    assert names.longest_contained(df, "f", table.limit(0), "w").where("found <> ''").count() == 0


def test_blocked_title_hits_come_key_by_key(spark):
    """Of one task the rows of a key, and of a statement in it, lie together (files of the result keep what repeats once), and none is lost."""
    stmt = spark.createDataFrame([(i, f"k{i % 30}" if i % 31 else "") for i in range(600)], "line long, k string").repartition(3)
    blocked = spark.createDataFrame([(f"k{i % 20}" if i % 29 else None, i) for i in range(200)], "k string, blocked_id long").repartition(3)
    got = G.blocked_title_hits(stmt, blocked, "k").withColumn("task", F.spark_partition_id()).collect()
    runs = sum(i == 0 or (a.task, a.k) != (b.task, b.k) for i, (a, b) in enumerate(zip(got, [None, *got[:-1]])))
    statements = sum(i == 0 or a.line != b.line for i, (a, b) in enumerate(zip(got, [None, *got[:-1]])))
    assert runs == len({(r.task, r.k) for r in got}) and statements == len({r.line for r in got})
    want = [(i, f"k{i % 30}", j) for i in range(600) for j in range(200) if i % 31 and j % 29 and i % 30 == j % 20]
    assert sorted((r.line, r.k, r.blocked_id) for r in got) == sorted(want)


def test_blocked_title_hits_of_a_hot_key_are_dealt_out(spark):
    """The statements of one key go to several tasks, and lists of contents lose no row at their ends."""
    stmt = spark.createDataFrame([(i, "hot" if i % 50 else f"k{i}") for i in range(2_000)], "line long, k string").repartition(2)
    blocked = spark.createDataFrame([("hot", i % 15) for i in range(30)] + [("k100", 7), ("k100", None), (None, 1), (" ", 2)], "k string, blocked_id long")
    want = sorted([(i, "hot", j % 15) for i in range(2_000) if i % 50 for j in range(30)] + [(100, "k100", 7), (100, "k100", None)], key=str)
    for each in (7, 4096):
        got = G.blocked_title_hits(stmt, blocked, "k", each=each).withColumn("task", F.spark_partition_id()).collect()
        assert sorted(((r.line, r.k, r.blocked_id) for r in got), key=str) == want
        tasks = [sum(r.k == "hot" and r.task == t for r in got) for t in {r.task for r in got}]
        assert len(tasks) > 1 and max(tasks) < 0.8 * sum(tasks)
    assert G.blocked_title_hits(stmt, blocked.limit(0), "k").collect() == [] and G.blocked_title_hits(stmt.limit(0), blocked, "k").collect() == []
