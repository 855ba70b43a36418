"""Scalar functions over text, ids, numbers and dates: Column in, Column out.

Missing text is "" throughout. Patterns carry (?U) so that white space and digits are those of Unicode. The one function without a
built-in is NFKC, a Java method that SQL calls: it needs no Python worker. Callers stage it in columns of its own so that it runs once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Text) -> Column:
    """Null -> "", Unicode white space trimmed. A column doesn't know its type, so NaN of a double becomes "NaN": number_text() and text_frame() take it for missing."""
    return F.coalesce(F.regexp_replace(col(c).cast("string"), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), F.lit(""))


def number_text(c: Text) -> Column:
    """text() of a float or double column: NaN counts as missing."""
    return F.when(F.isnan(col(c)), F.lit("")).otherwise(text(c))


def text_frame(df: DataFrame) -> DataFrame:
    """All columns as text, as tables are taken in: missing values, NaN among them, are ""."""
    return df.select(*((number_text if t in ("float", "double") else text)(F.col(f"`{c}`")).alias(c) for c, t in df.dtypes))


def normalize_number(c: Text) -> Column:
    """A number as text: an integral one without a point, "" if it is none."""
    d = amount_or_null(c)
    whole = (d == F.floor(d)) & (F.abs(d) < 1e18)
    return F.when(d.isNull() | F.isnan(d), F.lit("")).when(whole, d.try_cast("bigint").cast("string")).otherwise(d.cast("string"))


def nfkc(c: Text) -> Column:
    """c in NFKC, by the ICU library that Spark brings along. It agrees with Python's unicodedata on all characters that Python's version of
    Unicode assigns. ASCII stays as it is."""
    made = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), col(c), F.lit(True))  # true: compatibility forms, the K of NFKC
    return F.when(col(c).rlike(r"[^\x00-\x7F]"), made).otherwise(col(c))


def contains_any(c: Text, tokens: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(col(c), F.lit(t)) for t in tokens), F.lit(False))


def non_blank(c: Text) -> Column:
    """null where text(c) is blank."""
    return F.nullif(text(c), F.lit(""))


def norm_header(c: Text) -> Column:
    """Header in the form in which headers are compared. NFKC first where it may matter."""
    return F.regexp_replace(F.lower(text(c)), r"(?U)[\s\-–—_/\\:;.,()\[\]{}<>〈〉《》'\"`|+]", "")


def squash_header(c: Text) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(c).cast("string"), F.lit("")), r"(?U)\s+", " "))


def id_text(c: Text, mode: str = "digits") -> Column:
    """suffix: one trailing .0 goes; digits: only behind digits; int: also leading zeros and .000; float: any integral number as an integer."""
    t = text(c)
    if mode == "suffix":
        return F.regexp_replace(t, r"\.0$", "")
    if mode == "digits":
        return F.regexp_replace(t, r"^(\d+)\.0$", "$1")
    if mode == "int":
        return F.when(t.rlike(r"^\d+(\.0+)?$"), F.regexp_replace(F.regexp_extract(t, r"^(\d+)", 1), r"^0+(?=\d)", "")).otherwise(t)
    if mode == "float":
        plain = F.regexp_replace(F.regexp_extract(t, r"^\+?(-?\d+)(?:\.0*)?$", 1), r"^(-?)0+(?=\d)", "$1")
        power = F.when(t.rlike(r"^[+-]?\d+(\.\d+)?[eE][+-]?\d{1,2}$"), t.try_cast("double"))
        return F.when(plain != "", plain).when(power == F.floor(power), power.try_cast("decimal(38,0)").cast("string")).otherwise(t)
    raise ValueError(f"no such mode: {mode}")


def amount_parts(c: Text) -> Column:
    return F.regexp_replace(text(c), r"(?U)[,원\s]", "")


def parse_amount(c: Text) -> Column:
    """Strict: a number, or null; the caller keeps the raw text beside it."""
    t = amount_parts(c)
    return F.when(t.rlike(r"^-?\d+(\.\d+)?$"), t.try_cast("double"))


def amount_or_null(c: Text) -> Column:
    """Loose: whatever reads as a double."""
    return amount_parts(c).try_cast("double")


def int_or_zero(c: Text) -> Column:
    d = amount_or_null(c)
    return F.coalesce(F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d)).cast("double"), F.lit(0.0))


def numeric_zero(c: Text) -> Column:
    t = amount_parts(c)
    return (t == "") | F.coalesce(t.try_cast("double") == 0, F.lit(False))


def numeric_sum(c: Text) -> Column:
    return F.sum(F.coalesce(amount_or_null(c), F.lit(0.0)))


def excel_date(c: Text) -> Column:
    """All-digit serials count days from 1899-12-30; anything else stays."""
    t = text(c)
    days = t.try_cast("int")
    stamp = F.date_format(F.date_add(F.lit("1899-12-30").cast("date"), days), "yyyy-MM-dd HH:mm:ss")
    return F.when(t.rlike(r"^\d+$") & days.isNotNull(), stamp).otherwise(t)


def date_like(c: Text) -> Column:
    """YYYY-M-D with -, / or ., perhaps at midnight -> date, else null."""
    t = F.regexp_replace(F.regexp_replace(text(c), r"(?U)\s+00:00:00$", ""), r"[/.]", "-")
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(t, "yyyy-M-d"))


def is_yes(c: Text) -> Column:
    return F.upper(text(c)) == "Y"


def is_allowed(c: Text) -> Column:
    return F.startswith(text(c), F.lit("OK_"))


def split_reasons(c: Text) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), lambda p: text(p)), lambda p: p != "")


def append_reasons(a: Text, b: Text) -> Column:
    return F.array_join(F.array_distinct(F.concat(split_reasons(a), split_reasons(b))), " | ")


def pipe_ids(c: Text, label: str) -> Column:
    """Ids of 'label=a|b' inside an evidence text, as an array."""
    found = F.regexp_extract(F.coalesce(col(c), F.lit("")), rf"{label}=([^,]+)", 1)
    return F.filter(F.transform(F.split(found, r"\|"), lambda p: id_text(p)), lambda p: p != "")


def file_stem(c: Text) -> Column:
    base = F.regexp_extract(F.coalesce(col(c), F.lit("")), r"([^/\\]*)$", 1)
    return F.translate(F.regexp_replace(base, r"(?i)\.xlsx$", ""), '\\/:*?"<>|', "_________")


def display_ts(c: Text, zone: str = "Asia/Seoul") -> Column:
    """Timestamps in any of four forms, in UTC unless they name a zone, as local time text."""
    t = text(c)
    parsed = F.coalesce(*(F.try_to_timestamp(t, F.lit(f)) for f in ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")), F.try_to_timestamp(t))
    return F.date_format(F.from_utc_timestamp(parsed, zone), "yyyy-MM-dd HH:mm")


def unique_list(value: Text, order: Text, limit: int | None = None) -> Column:
    """Aggregate: distinct non-blank values in order of first appearance, as an array."""
    rows = F.array_sort(F.collect_list(F.struct(col(order).alias("o"), text(value).alias("v"))))
    values = F.array_distinct(F.filter(F.transform(rows, lambda r: r["v"]), lambda v: v != ""))
    return values if limit is None else F.slice(values, 1, limit)


# Words of a rule that name no header, and parts of a rule that say there is none.
RULE_WORDS = ("후보", "정책 필요", "필요", "있는 그룹만", "직접", "그 외", "상단", "기반", "적용 여부")
RULE_NONE = ("정책", "확정", "없음", "아님")


def field_candidates(rule: Text) -> Column:
    """The headers that a field's rule names, as an array in order: parts between / + x 또는 및 and commas, without words that name none."""
    r = F.coalesce(col(rule).cast("string"), F.lit(""))
    t = r
    for word in RULE_WORDS:
        t = F.replace(t, F.lit(word), F.lit(""))
    t = F.regexp_replace(t, r"(?U)\s+x\s+|\s*\+\s*| 또는 | 및 |,", "/")
    parts = F.transform(F.split(t, "/"), lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.trim(p, F.lit(" .")), r"(?U)\s*\([^)]*불명[^)]*\)", ""), r"(?U)\s*컬럼 선택 기준 확정 후.*$", "")))
    kept = F.filter(parts, lambda p: (p != "") & ~contains_any(p, RULE_NONE))
    return F.when(F.contains(r, F.lit("거래내용")), F.array(F.lit("거래내용"))).otherwise(kept)
