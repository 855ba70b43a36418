"""Guard tables (what a catalogue knows but the reference doesn't hold), their layouts and their place in the summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import id_text, text
from quillmatch.functions.titles import add_clean_key
from quillmatch.operators.gates import first_per
from quillmatch.operators.linkage import MATCHED


class Layout(NamedTuple):
    """Standard names with the raw names they may have (first one filled counts); which are ids; the id and title; a constant reason."""

    names: Mapping[str, Sequence[str]]
    ids: Sequence[str]
    id_col: str
    title: str = "title"
    reason: str | None = None


# The raw names are those of the interfaces that the tables are landed from.
MISSING = Layout(
    {
        "channel_content_id": ["schnCtnsId"], "content_id": ["ctnsId"], "title": ["ctnsNm"], "channel_id": ["schnId"], "channel": ["schnNm"],
        "group_id": ["grpCtnsId"], "group_title": ["grpCtnsNm"], "platform_content_id": ["pltfomCtnsId"], "shape": ["ctnsStleCdNm"], "content_status": ["ctnsStsCdNm"],
        "first_serial": ["frstSerlCmtDt"], "person": ["userNm"], "department": ["deptNm"], "settlement_begun": ["setlBgnYn"],
    },
    ("channel_content_id", "content_id", "channel_id", "group_id", "platform_content_id"), "channel_content_id", reason="missing",
)
BILLING = Layout(
    {
        "billing_id": ["reqSetlId"], "contract_id": ["cntrId"], "channel_id": ["schnId"], "channel": ["schnNm"], "title": ["reprsntCtnsNm"], "billing_status": ["reqSetlStsCdNm"],
        "approval": ["cnfmStsCdNm"], "partner": ["bcncNm"], "contract": ["cntrNm"], "contract_end": ["cntrCclsDt"], "contract_contents": ["cntrCtnsCnt"], "person": ["chgerNm"], "department": ["chrgDeptNm"],
    },
    ("billing_id", "contract_id", "channel_id", "contract_contents"), "billing_id", reason="billing",
)
SERVICE = Layout(
    {
        "platform": ["platform", "플랫폼"], "channel_id": ["schnId", "S2판매채널ID", "판매채널ID"], "channel": ["schnNm", "S2판매채널명", "판매채널명"], "partner_id": ["bcncCd", "거래처코드"], "partner": ["bcncNm", "거래처명"],
        "shape": ["ctnsStleCdNm", "판매채널콘텐츠_콘텐츠형태", "콘텐츠형태"], "channel_content_id": ["schnCtnsId", "판매채널콘텐츠ID"], "content_id": ["ctnsId", "콘텐츠ID"], "title": ["ctnsNm", "콘텐츠명"],
    },
    ("channel_id", "channel_content_id", "content_id"), "channel_content_id",
)


def normalize_guard(raw: DataFrame, layout: Layout, row_no: Sequence[str | Column]) -> DataFrame:
    """raw by its layout, as text, with clean_key (and reason); the first row in order of each id that isn't blank. Absent columns are ""."""

    def field(name: str, sources: Sequence[str]) -> Column:
        value = F.coalesce(*(F.nullif(text(F.col(f"`{c}`")), F.lit("")) for c in sources if c in raw.columns), F.lit(""))
        return (id_text(value) if name in layout.ids else value).alias(name)

    places = [(F.col(r) if isinstance(r, str) else r).alias(f"__r{i}") for i, r in enumerate(row_no)]
    out = raw.select(*(field(n, s) for n, s in layout.names.items()), *places)
    out = first_per(out, layout.id_col, [f"__r{i}" for i in range(len(places))]).drop(*(f"__r{i}" for i in range(len(places))))
    out = add_clean_key(out, layout.title)
    return out if layout.reason is None else out.withColumn("reason", F.lit(layout.reason))


def guard_summary(summary: DataFrame, explained: DataFrame, guards: Sequence[str] = ("missing", "billing", "service")) -> DataFrame:
    """summary(item, value) with rows that each guard hit and rows of each detail reason; items of the same name are replaced."""
    counts = [F.coalesce(F.sum((F.col(f"{g}_hits") > 0).cast("long")), F.lit(0)).alias(g) for g in guards]
    hits = explained.agg(*counts).select(F.explode(F.array(*(F.struct(F.lit(f"{g} candidates").alias("item"), F.col(g).alias("value")) for g in guards))).alias("x")).select("x.*")
    reasons = explained.where(text("detail_reason") != "").groupBy(F.concat(F.lit("no match: "), F.col("detail_reason")).alias("item")).agg(F.count("*").alias("value"))
    new = hits.unionAll(reasons)
    return summary.select("item", "value").join(new.select("item"), "item", "left_anti").unionAll(new)


def input_validation(sides: Mapping[str, tuple[DataFrame, str, str | None, DataFrame | None]], key: str = "clean_key", listed: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """item, value (text) of each input: sides[name] = (rows, title column, id column, index). Rows, names of columns, blank keys, keys of several ids,
    and the first ten values of the listed columns. One pass for each input; an index of None leaves its item out."""
    parts = []
    for name, (df, title, id_col, index) in sides.items():
        items = {"rows": F.count("*").cast("string"), "title column": F.lit(title), "blank keys": F.coalesce(F.sum((text(key) == "").cast("long")), F.lit(0)).cast("string")}
        if id_col:
            items["id column"] = F.lit(id_col)
        parts.append(_items(df, name, items))
        if index is not None:
            parts.append(_items(index, name, {"keys of several ids": F.coalesce(F.sum((F.col("id_count") > 1).cast("long")), F.lit(0)).cast("string")}))
        for c in (listed or {}).get(name, ()):
            values = df.select(text(c).alias("v")).where("v <> ''").distinct().orderBy("v").limit(10)
            parts.append(_items(values, name, {c: F.array_join(F.array_sort(F.collect_list("v")), " | ")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _items(df: DataFrame, name: str, items: Mapping[str, Column]) -> DataFrame:
    wide = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(items.values())))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(f"{name} {k}").alias("item"), F.col(f"c{i}").alias("value")) for i, k in enumerate(items)))).alias("x")).select("x.*")


def refresh_summary(tables: Mapping[str, tuple[DataFrame, DataFrame, Sequence[str]]], lookup: DataFrame, id_col: str) -> DataFrame:
    """part, item, n of a refresh: for each tables[name] = (raw, normalised, counted columns) raw rows, rows, rows by value; and ids shared with the lookup."""
    out = None
    for name, (raw, rows, counted) in tables.items():
        made = [raw.agg(F.lit("raw rows").alias("item"), F.count("*").alias("n")), rows.agg(F.lit("rows").alias("item"), F.count("*").alias("n"))]
        for c in counted:
            made.append(rows.groupBy(F.concat(F.lit(f"{c}: "), F.when(text(c) == "", F.lit("(blank)")).otherwise(text(c))).alias("item")).agg(F.count("*").alias("n")))
        if id_col in rows.columns:
            known = lookup.select(id_text(id_col).alias("_i")).distinct()
            made.append(rows.where(text(id_col) != "").select(id_text(id_col).alias("_i")).distinct().join(known, "_i", "left_semi").agg(F.lit("in lookup").alias("item"), F.count("*").alias("n")))
        for m in made:
            m = m.select(F.lit(name).alias("part"), "item", "n")
            out = m if out is None else out.unionAll(m)
    return out


def verify_ids(added: DataFrame, lookup: DataFrame, id_col: str, fields: Sequence[str], row_no: Sequence[str]) -> DataFrame:
    """added rows with an id, with found (Y/N) and the fields of the lookup's first row of that id as found_<field>."""
    one = first_per(lookup.withColumn("_i", id_text(id_col)), "_i", list(row_no)).select("_i", *(text(f).alias(f"found_{f}") for f in fields), F.lit("Y").alias("found"))
    rows = added.withColumn("_i", id_text(id_col)).where("_i <> ''")
    out = rows.join(one, "_i", "left")
    return out.select(*(c for c in added.columns if c != id_col), F.col("_i").alias(id_col), F.coalesce("found", F.lit("N")).alias("found"), *(F.coalesce(f"found_{f}", F.lit("")).alias(f"found_{f}") for f in fields))


def candidate_counts(candidates: DataFrame, channel: str, why: str = "excluded_because") -> DataFrame:
    """Candidates by channel and reason of exclusion; "safe" where there is none."""
    return candidates.groupBy(F.col(channel), F.when(text(why) == "", F.lit("safe")).otherwise(F.col(why)).alias(why)).agg(F.count("*").alias("n"))


def rerun_affected(before: DataFrame, stmt: DataFrame, added: DataFrame, channel: str, remap, row_ids: Sequence[str], status: str = "ref_status") -> DataFrame:
    """Statements of the channels that got additions, mapped again by remap(stmt): rows, matched before and after, newly matched, no longer matched by channel.

    Other channels aren't read again: the channels come as a semi-join before the mapping.
    """
    touched = added.select(channel).distinct()
    again = remap(stmt.join(touched, channel, "left_semi")).select(*row_ids, F.col(channel), F.col(status).alias("_new"))
    old = before.join(touched, channel, "left_semi").select(*row_ids, F.col(status).alias("_old"))
    was, now = F.coalesce(F.col("_old") == MATCHED, F.lit(False)), F.col("_new") == MATCHED
    n = lambda c, a: F.sum(c.cast("long")).alias(a)
    return again.join(old, list(row_ids), "left").groupBy(channel).agg(F.count("*").alias("rows"), n(was, "matched_before"), n(now, "matched_after"), n(now & ~was, "newly_matched"), n(was & ~now, "lost"))
