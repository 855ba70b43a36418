import pytest
from pyspark.sql import functions as F

from quillmatch.functions.text import field_candidates
from quillmatch.operators import audit as A
from quillmatch.operators import gates, sheets
from quillmatch.operators import guards as G
from quillmatch.operators import linkage as L
from quillmatch.operators import names as N
from quillmatch.operators import refresh as R
from quillmatch.sources import io


def evidence(spark, rows, keys, fields):
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in [*keys, *fields]) + ", n int")
    return L.evidence_index(df, keys, fields, "n")


def test_sources_of_a_row_without_match(spark):
    keys = ["ch", "key"]
    guards = [
        ("missing", evidence(spark, [("A", "k", "m1", 1), ("A", "dup", "m2", 2)], keys, ["id"]), keys, ["id"]),
        ("service", evidence(spark, [("A", "k", "s1", 1), ("A", "s", "s2", 2), ("A", "s", "s3", 3)], keys, ["id"]), keys, ["id"]),
        ("billing", evidence(spark, [("A", "k", "b1", 1)], keys, ["id"]), keys, ["id"]),
        ("other_channel", evidence(spark, [("o", "A", "1", 1), ("o", "B", "2", 2), ("own", "A", "3", 3), ("unknown", "", "4", 4)], ["key"], ["ch", "id"]).withColumnRenamed("ch", "known"), ["key"], ["known", "id"]),
        ("master", evidence(spark, [("m", "c1", 1)], ["key"], ["id"]), ["key"], ["id"]),
    ]
    rows = [("A", k, "no_match", "why") for k in ("k", "s", "o", "own", "unknown", "m", "none")]
    rows += [("A", "k", "matched", ""), ("A", "", "blank_key", "no key"), ("A", "dup", "ambiguous", "why")]
    df = spark.createDataFrame(rows, "ch string, key string, ref_status string, review_reason string").withColumn("review", F.lit("N"))
    got = {(r.key, r.ref_status): r for r in L.explain_no_match(df, guards, key="key", channel="ch").collect()}
    no = lambda k: got[k, "no_match"]
    assert (no("k").detail_reason, no("k").split_reason, no("k").review_reason, no("k").review) == ("missing | billing", "missing | billing", "why | missing | billing", "Y")
    assert (no("k").missing_hits, no("k").service_hits, no("k").detail_evidence) == (1, 0, "missing: id=m1 || billing: id=b1")
    assert (no("s").detail_reason, no("s").service_hits, no("s").detail_evidence, no("s").split_reason) == ("service", 2, "service: id=s2 | s3", "")
    assert (no("o").detail_reason, no("o").detail_evidence, no("o").detail_action) == ("other_channel", "other_channel: known=B, id=1 | 2", L.ACTIONS["other_channel"])
    assert (no("own").detail_reason, no("own").detail_evidence, no("own").detail_action) == ("no candidate", "key=own", L.ACTIONS["none"])
    assert (no("unknown").detail_reason, no("m").detail_reason) == ("other_channel", "master")
    assert (got["k", "matched"].detail_reason, got["k", "matched"].detail_action, got["k", "matched"].missing_hits, got["k", "matched"].review) == ("", "", 0, "N")
    assert (got["", "blank_key"].detail_reason, got["", "blank_key"].detail_action) == ("no key", L.ACTIONS["blank_key"])
    assert (got["dup", "ambiguous"].detail_reason, got["dup", "ambiguous"].split_reason, got["dup", "ambiguous"].detail_action) == ("status ambiguous", "missing", L.ACTIONS["ambiguous"])
    summary = spark.createDataFrame([("rows", 9), ("missing candidates", 99)], "item string, value long")
    items = {r["item"]: r.value for r in G.guard_summary(summary, L.explain_no_match(df, guards, key="key", channel="ch")).collect()}
    assert items["missing candidates"] == 2 and items["rows"] == 9 and items["no match: other_channel"] == 2 and "no match: " not in items


def test_guard_layouts(spark):
    raw = spark.createDataFrame([("7.0", " [BL] 효종 ", None, 2), ("7", "later", "x", 3), ("", "no id", "x", 1), (None, "no id", "x", 4)], "schnCtnsId string, ctnsNm string, `판매채널명` string, n int")
    got = G.normalize_guard(raw, G.MISSING, ["n"]).collect()
    assert [(r.channel_content_id, r.title, r.clean_key, r.department, r.reason) for r in got] == [("7", "[BL] 효종", "효종", "", "missing")]
    assert [(r.channel_content_id, r.channel) for r in G.normalize_guard(raw, G.SERVICE, ["n"]).collect()] == [("7", "")]
    assert G.normalize_guard(raw.where("false"), G.SERVICE, ["n"]).count() == 0
    assert G.normalize_guard(raw, G.BILLING, ["n"]).count() == 0


def test_field_candidates(spark):
    rules = ["상품명 후보 / 작품명", "금액 x 비율 + 합계", "없음", "A 또는 B 및 C, 정책 확정", "거래내용 기반 분리", None, "", "정산액 (단위 불명)"]
    got = [r.c for r in spark.createDataFrame([(i, r) for i, r in enumerate(rules)], "i int, r string").select("i", field_candidates("r").alias("c")).orderBy("i").collect()]
    assert got == [["상품명", "작품명"], ["금액", "비율", "합계"], [], ["A", "B", "C"], ["거래내용"], [], [], ["정산액"]]


def test_channels_of_files(spark):
    channels = spark.createDataFrame([("네이버_장르", "네이버"), ("네이버_장르(광고수익)", "네이버"), ("토스(구루컴퍼니)", "토스"), ("a", "P1"), ("a", "P2"), (None, "x")], "c string, p string")
    names = ["2026년 2월 네이버_장르(광고수익) 정산상세.xlsx", "2026-02__토스(구루컴퍼니)__네이버_장르.xlsx", "2026년 2월 카카오 정산상세.xlsx", "x\\y\\네이버 장르.xlsx", "a/없음.xlsx", None]
    files = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = [(r.channel, r.platform) for r in N.detect_channel(files, "name", channels, "c", "p").orderBy("i").collect()]
    assert got == [("네이버_장르(광고수익)", "네이버"), ("토스(구루컴퍼니)", "토스"), ("", ""), ("네이버_장르", "네이버"), ("", ""), ("", "")]
    assert {r.status for r in L.assign_channels(N.detect_channel(files, "name", channels, "c", "p")).collect()} == {"ok", "choose"}
    assert L.assign_channels(files.withColumns({"channel": F.lit(""), "platform": F.lit("")}), chosen="a").first().applied == "a"
    names = [("네이버", "네이버 광고 장르.xlsx"), ("네이버", "네이버 연 재.xlsx"), ("네이버", "네이버.xlsx"), ("카카오", "창작지원금"), ("else", "x")]
    files = spark.createDataFrame(names, "platform string, name string")
    chosen = {r.name: r for r in A.choose_rule(files, A.name_rules(spark), "name").collect()}
    assert [chosen[n].exact for _, n in names] == [["네이버_장르(광고수익)"], ["네이버_연재"], ["네이버_장르", "네이버_연재", "네이버_일반"], ["카카오페이지(창작지원금)"], None]
    ref = spark.createDataFrame([("네이버_장르",), ("네이버_연재",), ("z",)], "ch string")
    passed = {(r.name, r.ch) for r in A.channels_for(A.choose_rule(files, A.name_rules(spark), "name"), "name", ref, "ch").collect()}
    assert passed == {("네이버 연 재.xlsx", "네이버_연재"), ("네이버.xlsx", "네이버_장르"), ("네이버.xlsx", "네이버_연재"), ("x", "네이버_장르"), ("x", "네이버_연재"), ("x", "z")}


def test_refreshed_lookup(spark):
    schema = "id string, d string, title string, content string, `작가명` string, author string, n int"
    old = spark.createDataFrame([("301.0", "45000", "<일>_x", "1", "갑", "갑", 1), ("999", "", "이", "c2", None, None, 2)], schema)
    new = spark.createDataFrame([("301", "2026-01-01", "<일>_y", "1.0", "갑", "을", 1), ("301", "2025-01-01", "old", "c9", "", "", 2), ("777", None, "칠", "", "", "", 3), ("5", None, "[사용안함] 오", "", "", "", 4), (None, None, None, None, None, None, None)], schema)
    got = R.refresh_lookup(old, new, "id", "d", ["n"], "title", ["content"])
    changes = {r.id: (r.change, r.changed_fields, r.new_authors) for r in got.changes.collect()}
    assert changes == {"301": ("modified", ["authors"], "갑 | 을"), "777": ("added", [], ""), "999": ("deleted", [], None)}
    assert {r.id for r in got.lookup.collect()} == {"301", "777"} and got.summary.first() == (1, 1, 1)
    with pytest.raises(ValueError):
        R.refresh_lookup(old, new, "id", "d", ["n"], "title", ["content"], mode="merge")
    with pytest.raises(ValueError):
        R.split_master(old, ["absent"], "title", "x", "d", {})
    with pytest.raises(ValueError):
        gates.load_status(old, "id", "status")


def test_layouts_and_sheets(spark):
    a, b = spark.createDataFrame([("x",)], "z string"), spark.createDataFrame([("1", "ok")], "rawId string, status string")
    assert io.load_payment([a, b], ["id", "status"], {"id": "rawId"}).columns == ["id", "status"]
    with pytest.raises(ValueError, match="id, status"):
        io.load_payment([a], ["id", "status"], {"id": "rawId"})
    cells = spark.createDataFrame([("f", "s", 1, 1, "상품명", "로망띠끄"), ("f", "s", 1, 2, "e-ISBN__2", "로망띠끄"), ("f", "s", 2, 1, "t", "로망띠끄"), ("f", "s", 2, 2, "978", "로망띠끄"), ("g", "s", 1, 1, "상품명", "else"), ("g", "s", 1, 2, "ISBN", "else")], "source_file string, sheet string, row int, col int, value string, platform string")
    known = spark.createDataFrame([("title", "상품명", 0)], "field string, header string, pos int")
    blocked = spark.createDataFrame([("로망띠끄", "isbn")], "platform string, word string")
    left = sheets.drop_blocked_columns(cells, sheets.find_header(cells, known), blocked)
    assert {(r.source_file, r.row, r.col) for r in left.collect()} == {("f", 1, 1), ("f", 2, 1), ("g", 1, 1), ("g", 1, 2)}
    rows = spark.createDataFrame([("P", "한아름 web"), ("P", "아름"), ("Q", "한아름 web"), ("P", None)], "platform string, title string")
    rules = spark.createDataFrame([("P", "한아름", "web")], "platform string, prefix string, suffix string")
    assert sheets.drop_platform_totals(rows, rules).count() == 3
    runs = spark.createDataFrame([(1, "initial"), (2, "custom"), (3, "odd")], "run_id int, mode string")
    assert [tuple(r) for r in A.history_view(runs, {"run_id": "ID", "mode": "scope", "no": "no"}, {"mode": {"custom": "range"}}, 2).collect()] == [(3, "odd"), (2, "range")]
    added = spark.createDataFrame([("1.0", "w"), ("", "w"), ("3", "w")], "id string, w string")
    lookup = spark.createDataFrame([("1", "B", 2), ("1", "A", 1)], "id string, ch string, n int")
    assert {(r.id, r.found, r.found_ch) for r in G.verify_ids(added, lookup, "id", ["ch"], ["n"]).collect()} == {("1", "Y", "A"), ("3", "N", "")}
