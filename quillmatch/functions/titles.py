"""Titles to match keys."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import col, contains_any, nfkc, text

# The rules of the key.
DISABLED_MARKERS = ("[사용안함]", "(사용안함)", "[사용금지]", "(사용금지)", "[정산정보없음]", "(정산정보없음)")
EXCEPTIONS = ("24/7", "실명마제", "라마대제")
CONFIRMED = "확정"
CONFIRMED_TAIL = 4
ANGLES = (r"<([^<>]+)>", r"＜([^＜＞]+)＞", r"〈([^〈〉]+)〉", r"《([^《》]+)》")
CONTRACT_TOKENS = ("계약서", "발행권", "신작")
WRAPPER_TAGS = ("bl", "gl", "tl", "19", "19금", "성인", "연재", "단행본", "외전", "완결")
PHRASES = ("세트구매", "난세의 서 편", "초혼의 사자 편", "전설의 부활 편")
KEYWORDS = ("개정판 l", "개정판", "증보판", "외전", "무삭제본", "무삭제판", "합본", "단행본", "시즌", "세트", "연재", "특별", "최종화", "완결", "2부", "무삭제", "완전판", "세개정판", "19세개정판")
ALIASES = {
    "늙은경비에게조교당하는스튜어디스의이야기": "늙은경비에게조교당하는스튜어디스",
    "늙은경비에게조교당하는스튜어디스이야기": "늙은경비에게조교당하는스튜어디스",
    "천대받는f급힐러라좋았는데요": "천대받는f급힐러라서좋았는데요",
    "던전에서성자가하는일": "던전에서성자性者가하는일",
    "백치공주시리즈": "백치공주",
    "악작현대au": "악작",
    "보수적이라며팬티는왜벗어": "보수적인데팬티는왜벗어",
    "스피크오브더데블": "speakofthedevil",
    "중력술사아스께기맨": "중력술사아스께끼맨",
    "내가키운용사가나에게집착한다": "내가키운용사가나한테집착한다",
    "망겜의고인물로살아남기프롤로그": "망겜의고인물로살아남기",
    "플레이싱어느대공각하의장난감": "plaything어느대공각하의장난감",
    "보이즈돈크라이": "boysdontcry",
    "sm클럽암캐가된여자들": "sm클럽",
    "고인물무림에가다": "고인물무림에가다갈드창작지원금",
}


@dataclass(frozen=True)
class CleaningPolicy:
    """What may be changed without code."""

    markers: tuple[str, ...] = DISABLED_MARKERS
    exceptions: tuple[str, ...] = EXCEPTIONS
    angles: tuple[str, ...] = ANGLES
    confirmed: str = CONFIRMED
    confirmed_tail: int = CONFIRMED_TAIL
    aliases: dict[str, str] = field(default_factory=lambda: dict(ALIASES))


DEFAULT = CleaningPolicy()


def has_marker(c: Column | str, policy: CleaningPolicy = DEFAULT) -> Column:
    return contains_any(nfkc(text(c)), policy.markers)


def structured_segment(c: Column | str) -> Column:
    """The title of 'number_title_..._일반', or ""."""
    return text(F.regexp_extract(col(c), r"(?U)^\d+_([^_]+)_[^_]+_일반$", 1))


def square_inner(c: Column | str, policy: CleaningPolicy = DEFAULT) -> Column:
    """What a title wholly in square brackets holds, in NFKC, unless that is a marker or a tag; else ""."""
    inner = text(nfkc(F.regexp_extract(col(c), r"^\[([^\[\]]+)\]$", 1)))
    names = [m.strip("[]()").lower() for m in policy.markers] + list(WRAPPER_TAGS)
    return F.when(F.lower(inner).isin(names), F.lit("")).otherwise(inner)


def contract_title(normalised: Column | str) -> Column:
    """The last (...) of a contract's name in NFKC; else ""."""
    c = col(normalised)
    return F.when(contains_any(c, CONTRACT_TOKENS), text(F.regexp_extract(c, r"(?U)\(([^()]*)\)\s*$", 1))).otherwise(F.lit(""))


def _cut(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, "(?U)" + pattern, "")


def add_clean_key(df: DataFrame, title: str, key: str = "clean_key", policy: CleaningPolicy = DEFAULT) -> DataFrame:
    """df with the match key of title. The order of the steps matters; each NFKC step is a column of its own. A title that is a date is its month and day."""
    base, shown, body, inside = "__t0", "__t1", "__t2", "__t3"
    if dict(df.dtypes)[title] in ("date", "timestamp", "timestamp_ntz"):
        day = F.concat(F.month(title).cast("string"), F.lit("월"), F.dayofmonth(title).cast("string"), F.lit("일"))
        return df.withColumn(key, F.coalesce(day, F.lit("")))
    t = _cut(_cut(text(title), r"\s*~[^~]+~\s*$"), r"\s+\d+부(?:\s*-\s*.*)?$")
    out = df.withColumn(base, t).withColumn(shown, nfkc(base))
    contract = contract_title(shown)
    t = F.when(contract != "", contract).otherwise(F.col(base))
    structured = structured_segment(t)
    t = F.when(structured != "", structured).otherwise(t)
    t = F.lower(_cut(t, r"\s*\d+/\d+$"))
    t = F.regexp_replace(t, r"(?U)(^|\s)제\s*\d+[권화]", " ")
    t = F.translate(t, "?~,-_", "")
    out = out.withColumn(body, t)
    out = out.withColumn(inside, square_inner(body, policy))
    t = F.when(F.col(inside) != "", F.col(inside)).otherwise(F.col(body))
    t = _cut(_cut(t, r"\([^)]*\)|\[[^\]]*\]"), r"【[^】]*】")
    for phrase in PHRASES:
        t = F.replace(t, F.lit(phrase), F.lit(""))
    out = out.withColumn(body, nfkc(t))
    t = _cut(F.col(body), r"\d+\s*[권화부회]")
    for word in KEYWORDS:
        t = F.replace(t, F.lit(word), F.lit(""))
    t = F.regexp_replace(_cut(t, r"\d+"), r"\.+$", "")
    t = _cut(t, r"[.,~\-–—!@#$%^&*_=+\\|/:;\"'`<>?，｡､{}()\[\]]")
    t = F.lower(_cut(_cut(t, r"특별$"), r"[\s\x1c-\x1f]+"))
    if policy.aliases:
        table = F.create_map(*(F.lit(x) for pair in policy.aliases.items() for x in pair))
        t = F.coalesce(F.try_element_at(table, t), t)
    special = F.coalesce(*(F.when(F.contains(F.col(base), F.lit(e)), F.lit(e.lower())) for e in policy.exceptions)) if policy.exceptions else F.lit(None).cast("string")
    dated = F.when(F.col(base).rlike(r"(?U)^\d{1,2}월\d{1,2}일$"), F.lower(base))
    out = out.withColumn(body, F.coalesce(special, dated, t))
    return out.withColumn(key, F.col(body)).drop(*({base, shown, body, inside} - {key}))


def add_master_title(df: DataFrame, title: str, out: str = "master_title", policy: CleaningPolicy = DEFAULT) -> DataFrame:
    """The content's name inside a master's title: in angle brackets, or before the fields of a confirmed title, or all of it."""
    raw, last = "__m0", "__m1"
    df = df.withColumn(raw, nfkc(text(title)))
    parts = F.filter(F.transform(F.split(raw, "_"), lambda p: text(p)), lambda p: p != "")
    n = F.size(parts)
    df = df.withColumn(last, F.when(n > policy.confirmed_tail, F.element_at(parts, -1)).otherwise(F.lit("")))
    df = add_clean_key(df, last, last + "k", policy)
    head = text(F.array_join(F.slice(parts, F.lit(1), F.greatest(n - policy.confirmed_tail, F.lit(0))), "_"))
    confirmed = F.when((n > policy.confirmed_tail) & (F.col(last + "k") == policy.confirmed), F.nullif(head, F.lit("")))
    angled = [F.nullif(text(F.regexp_extract(F.col(raw), p, 1)), F.lit("")) for p in policy.angles]
    return df.withColumn(out, F.coalesce(*angled, confirmed, F.col(raw))).drop(*({raw, last, last + "k"} - {out}))


def add_clean_master_key(df: DataFrame, title: str, key: str = "clean_key", policy: CleaningPolicy = DEFAULT) -> DataFrame:
    return add_clean_key(add_master_title(df, title, "__mt", policy), "__mt", key, policy).drop("__mt")


def drop_disabled(df: DataFrame, columns: list[str] | None = None, policy: CleaningPolicy = DEFAULT) -> DataFrame:
    """Rows without a disabled marker in any of the columns (all text columns by default)."""
    names = columns or [n for n, t in df.dtypes if t == "string"]
    if not names:
        return df
    joined = F.concat_ws("\n", *(F.col(n) for n in names))  # one NFKC for all columns: no marker holds a newline
    return df.where(~has_marker(joined, policy))
