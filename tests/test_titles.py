import pytest

from quillmatch.functions import text as T
from quillmatch.functions.titles import CleaningPolicy, add_clean_key, add_clean_master_key, add_master_title, drop_disabled
from pyspark.sql import functions as F

KEYS = [
    ("[효종]", "효종"), ("[BL] 효종", "효종"), ("[BL]", ""), ("[사용안함]", ""), ("파공검제 30권", "파공검제"), ("파공검 제30권", "파공검"), ("마교육제 242화", "마교육제"),
    ("평화로운 먼치킨 영지 5 화", "평화로운먼치킨영지"), ("12_조금은 야한 우리 회사_파워레인젖_일반", "조금은야한우리회사"),
    ("배타적 발행권 설정계약서_김현준 작가_신작 1종 (EX급 만능사제가 되었다)", "ex급만능사제가되었다"), ("추억， 순간의 바람이 되어 1권", "추억순간의바람이되어"),
    ("독식하는 재벌 3세", "독식하는재벌세"), ("1980 독식하는 재벌!", "독식하는재벌"), (None, ""), ("  ", ""), ("7월24일", "7월24일"), ("한 권 24/7 외전", "24/7"), ("백치공주 시리즈", "백치공주"), ("세개정판", "세"),
]


def test_clean_key(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(KEYS)], "i int, t string")
    got = {r.i: r.clean_key for r in add_clean_key(df, "t").collect()}
    assert [got[i] for i in range(len(KEYS))] == [k for _, k in KEYS]


def test_master_title(spark):
    rows = [("<그 남자의 비밀>_홍길동_100_200_확정", "그 남자의 비밀"), ("너_그리고_나_홍길동_1001234_2002345_확정", "너_그리고_나"), ("보통 제목", "보통 제목"), (None, "")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r.i: r.master_title for r in add_master_title(df, "t").collect()}
    assert [got[i] for i in range(len(rows))] == [m for _, m in rows]
    assert add_clean_master_key(df, "t").where("i = 1").first().clean_key == "너그리고나"


def test_drop_disabled(spark):
    df = spark.createDataFrame([("a", "b", 1), ("x［사용안함］", "b", 2), ("a", "(사용금지)", 3)], "a string, b string, n int")
    assert [r.n for r in drop_disabled(df).collect()] == [1]
    assert [r.n for r in drop_disabled(df, ["a"]).orderBy("n").collect()] == [1, 3]
    assert drop_disabled(df, policy=CleaningPolicy(markers=("b",))).count() == 1


@pytest.mark.parametrize(
    "fn, rows",
    [
        (lambda c: T.id_text(c), [("12.0", "12"), ("a.0", "a.0"), (" 7 ", "7"), (None, "")]),
        (lambda c: T.id_text(c, "suffix"), [("a.0", "a"), ("12.00", "12.00".removesuffix(".0"))]),
        (lambda c: T.id_text(c, "int"), [("0012.00", "12"), ("0", "0"), ("x", "x")]),
        (lambda c: T.id_text(c, "float"), [("12.0", "12"), ("1e3", "1000"), ("1.5", "1.5"), ("-3.", "-3"), ("9007199254740993", "9007199254740993")]),
        (lambda c: T.parse_amount(c), [("1,234원", 1234.0), ("-5.5", -5.5), ("1e3", None), ("", None)]),
        (lambda c: T.amount_or_null(c), [("1e3", 1000.0), ("x", None), ("1 000", 1000.0)]),
        (lambda c: T.int_or_zero(c), [("-1.9", -1.0), ("x", 0.0), ("2.9", 2.0)]),
        (lambda c: T.numeric_zero(c), [("", True), ("0.0", True), ("1", False), ("x", False)]),
        (lambda c: T.excel_date(c), [("45000", "2023-03-15 00:00:00"), ("2024-01-01", "2024-01-01")]),
        (lambda c: T.date_like(c).cast("string"), [("2026/7/24", "2026-07-24"), ("2026.7.4 00:00:00", "2026-07-04"), ("x", None), ("2026-13-01", None)]),
        (lambda c: T.append_reasons(c, F.lit("b | c")), [("a | b", "a | b | c"), (None, "b | c")]),
        (lambda c: F.array_join(T.pipe_ids(c, "id"), ","), [("x: id=1.0|2, y", "1,2"), ("", "")]),
        (lambda c: T.file_stem(c), [("a/b\\c:d.xlsx", "c_d"), (None, "")]),
        (lambda c: T.norm_header(c), [(" Sale_Amount (원) ", "saleamount원")]),
        (lambda c: T.squash_header(c), [(" a \n b ", "a b"), (None, "")]),
    ],
)
def test_scalars(spark, fn, rows):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(rows)], "i int, c string")
    got = {r.i: r.v for r in df.select("i", fn(F.col("c")).alias("v")).collect()}
    assert [got[i] for i in range(len(rows))] == [b for _, b in rows]
