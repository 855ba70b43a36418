"""Reference indexes, matching of statements, explanations of what didn't match, and the transfer gate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions.text import amount_or_null, append_reasons, text

MATCHED, NO_MATCH, AMBIGUOUS, BLANK, SKIPPED = "matched", "no_match", "ambiguous", "blank_key", "skipped"
LIST_LIMIT = 30


def capped_list(df: DataFrame, keys: Sequence[str], value: str, order: Column, name: str, limit: int = LIST_LIMIT) -> DataFrame:
    """keys, name: distinct non-blank values in order of first appearance, `limit` at most; n_<name>: how many there are.

    Distinct values are aggregated before they meet and ranked before they are gathered, so no list outgrows its cap.
    """
    firsts = df.where(text(value) != "").groupBy(*keys, text(value).alias("v")).agg(F.min(order).alias("o"))
    ranked = firsts.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("r") <= limit)
    lists = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "v"))), lambda x: x["v"]).alias(name))
    return lists.join(firsts.groupBy(*keys).agg(F.count("*").alias(f"n_{name}")), list(keys))


def capped_lists(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Column, counted: bool = False, limit: int = LIST_LIMIT) -> DataFrame:
    """keys, hits (rows of the key) and for each of values an array as capped_list makes it, in one pass over df; counted: n_<value> too."""
    tagged = [F.struct(F.lit(-1).alias("f"), F.lit("").alias("v")), *(F.struct(F.lit(i).alias("f"), text(v).alias("v")) for i, v in enumerate(values))]
    long = df.select(*keys, order.alias("_by"), F.explode(F.array(*tagged)).alias("_x")).where("_x.f = -1 or _x.v <> ''")
    firsts = long.groupBy(*keys, F.col("_x.f").alias("_f"), F.col("_x.v").alias("_v")).agg(F.min("_by").alias("_by"), F.count("*").alias("_c"))
    ranked = firsts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_f").orderBy("_by"))).where(F.col("_r") <= limit)
    one = lambda i: F.transform(F.array_sort(F.collect_list(F.when(F.col("_f") == i, F.struct("_r", "_v")))), lambda x: x["_v"])
    lists = ranked.groupBy(*keys).agg(F.max(F.when(F.col("_f") == -1, F.col("_c"))).alias("hits"), *(one(i).alias(v) for i, v in enumerate(values)))
    if not counted:
        return lists
    return lists.join(firsts.groupBy(*keys).agg(*(F.sum((F.col("_f") == i).cast("long")).alias(f"n_{v}") for i, v in enumerate(values))), list(keys))


def candidate_order(df: DataFrame, keys: Sequence[str], dates: Sequence[str], row_no: str, out: str = "_o") -> DataFrame:
    """Adds out, an order within each key: by the first of `dates` that has a value anywhere in the key, latest first, then input order;
    and basis, the name of that column ("" if none)."""
    if not dates:
        return df.withColumn(out, F.struct(F.lit(0).cast("long").alias("d"), F.col(row_no).alias("r"))).withColumn("basis", F.lit("")).withColumn("basis_value", F.lit(""))
    have = df.groupBy(*keys).agg(*(F.max(F.col(d).isNotNull()).alias(f"_h{i}") for i, d in enumerate(dates)))
    pick = F.coalesce(*(F.when(F.col(f"_h{i}"), F.lit(d)) for i, d in enumerate(dates)), F.lit(""))
    joined = df.join(have.select(*keys, pick.alias("basis")), list(keys))
    chosen = F.coalesce(*(F.when(F.col("basis") == d, F.col(d).cast("timestamp")) for d in dates))
    late = -F.coalesce(F.unix_micros(chosen), F.lit(-(1 << 62)))
    value = F.coalesce(F.date_format(chosen, "yyyy-MM-dd"), F.lit(""))
    return joined.withColumn(out, F.struct(late.alias("d"), F.col(row_no).alias("r"))).withColumn("basis_value", value)


def candidate_index(df: DataFrame, keys: Sequence[str], id_col: str, title_col: str, row_no: str, dates: Sequence[str] = (), content_col: str | None = None, extras: Sequence[str] = ()) -> DataFrame:
    """One row a key: how many rows and distinct ids, the ids and titles in candidate order (capped), the selected id, title and content.

    The last of keys is the clean key; rows where it is blank are left out. A key without any id is kept as no_match. Id, title and content
    are each the first that isn't blank and may come from different rows. Dates are date or timestamp columns, row_no is unique.
    """
    rows = candidate_order(df.where(text(keys[-1]) != ""), keys, dates, row_no)
    first = lambda c: F.min_by(F.nullif(text(c), F.lit("")), F.when(text(c) != "", F.col("_o")))
    picked = [F.count("*").alias("rows"), first(id_col).alias("selected_id"), first(title_col).alias("selected_title"), F.min_by("basis_value", "_o").alias("basis_value"), F.first("basis").alias("basis")]
    if content_col:
        picked.append(first(content_col).alias("selected_content"))
    listed = dict(zip(("ids", "titles", *(f"list_{x}" for x in extras)), (id_col, title_col, *extras), strict=True))
    lists = capped_lists(rows.withColumns({n: F.col(c) for n, c in listed.items()}), keys, list(listed), F.col("_o"), counted=True).drop("hits")
    out = rows.groupBy(*keys).agg(*picked).join(lists, list(keys))
    ids = F.col("n_ids")
    shown = [F.array_join(c, " | ").alias(c) for c in listed]
    content = [F.coalesce("selected_content", F.lit("")).alias("selected_content")] if content_col else []
    return out.select(
        *keys, F.when(ids > 0, F.lit(MATCHED)).otherwise(F.lit(NO_MATCH)).alias("status"), "rows", ids.alias("id_count"),
        F.coalesce("selected_id", F.lit("")).alias("selected_id"), F.coalesce("selected_title", F.lit("")).alias("selected_title"), *content, "basis", "basis_value", *shown,
    )


def match(stmt: DataFrame, index: DataFrame, on: Sequence[str], prefix: str) -> DataFrame:
    """stmt with the index's columns under prefix; every row once. The index has one row a key, so rows never multiply; whether it is
    broadcast is left to Spark, which knows its size."""
    renamed = index.select(*on, *(F.col(c).alias(prefix + c) for c in index.columns if c not in on))
    out = stmt.join(renamed, list(on), "left")
    status = F.when(text(on[-1]) == "", F.lit(BLANK)).otherwise(F.coalesce(prefix + "status", F.lit(NO_MATCH)))
    fill = [F.coalesce(prefix + c, F.lit("")).alias(prefix + c) if t == "string" else F.coalesce(prefix + c, F.lit(0)).alias(prefix + c) for c, t in index.dtypes if c not in on and c != "status"]
    return out.select(*stmt.columns, status.alias(prefix + "status"), *fill)


def map_statements(stmt: DataFrame, ref_index: DataFrame, on: Sequence[str], master_index: DataFrame | None = None, master_on: Sequence[str] = ("clean_key",), clustered: bool = False) -> DataFrame:
    """Statement rows with ref_* and master_* columns, review_reason and review (Y/N). Without a master its status is skipped.

    The distinct keys of the statements are matched, then joined with the statements once: an index's lists move once a key, never once a row.
    clustered: rows come in order of their keys within each task, so that a table written from them holds each key's lists about once.
    """
    keys = list(dict.fromkeys([*on, *(master_on if master_index is not None else ())]))
    known = match(stmt.select(*keys).distinct(), ref_index, on, "ref_")
    known = known.withColumn("master_status", F.lit(SKIPPED)) if master_index is None else match(known, master_index, master_on, "master_")
    reasons = [F.when(text(on[-1]) == "", F.lit("no key"))]
    for side in ("ref", "master"):
        for status, what in ((NO_MATCH, "not mapped"), (AMBIGUOUS, "several candidates"), (BLANK, "cannot be matched")):
            reasons.append(F.when(F.col(f"{side}_status") == status, F.lit(f"{side} {what}")))
    reason = F.array_join(F.array_compact(F.array(*reasons)), " | ")
    known = known.withColumn("review_reason", reason).withColumn("review", F.when(reason != "", F.lit("Y")).otherwise(F.lit("N")))
    added = [c for c in known.columns if c not in keys]
    known = known.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *added)
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))
    return stmt.join(known.hint("merge") if clustered else known, same).select(*stmt.columns, *added)


def with_source_columns(rows: DataFrame, prefix: str = "source_", known: Sequence[str] = ()) -> DataFrame:
    """rows with the columns that aren't known (the statement schema's by default, and what mapping adds) under a prefix, behind the others."""
    own = set(known) | {c for c in rows.columns if c.startswith(("ref_", "master_"))} | {"review", "review_reason", "clean_key"}
    return rows.select(*(c for c in rows.columns if c in own), *(F.col(f"`{c}`").alias(prefix + c) for c in rows.columns if c not in own))


def all_duplicates(sides: dict[str, DataFrame]) -> DataFrame:
    """The duplicates of several references in one table, with the reference's name; columns that a side lacks are null."""
    out = None
    for name, df in sides.items():
        df = df.select(F.lit(name).alias("reference"), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def duplicates(index: DataFrame, stmt: DataFrame, on: Sequence[str]) -> DataFrame:
    """Index rows of several ids whose key occurs in the statements."""
    return index.where("id_count > 1").join(stmt.where(text(on[-1]) != "").select(*on), list(on), "left_semi")


def summary_counts() -> dict[str, Column]:
    """What a mapping's summary counts, by name, as aggregates over mapped rows."""
    n = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    items = {"rows": F.count("*"), "review": n(F.col("review") == "Y")}
    for side in ("ref", "master"):
        for status in (MATCHED, AMBIGUOUS, NO_MATCH, BLANK) + ((SKIPPED,) if side == "master" else ()):
            items[f"{side} {status}"] = n(F.col(f"{side}_status") == status)
    return items


def mapping_summary(rows: DataFrame, dup: DataFrame | None = None) -> DataFrame:
    """item, value over mapped rows, in one pass (and the number of duplicate keys)."""
    items = summary_counts()
    wide = rows.agg(*(c.alias(f"c{i}") for i, c in enumerate(items.values())))
    long = wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("item"), F.col(f"c{i}").alias("value")) for i, k in enumerate(items)))).alias("x")).select("x.*")
    return long if dup is None else long.unionAll(dup.agg(F.lit("duplicate keys").alias("item"), F.count("*").alias("value")).select("item", "value"))


def exclude(ref: DataFrame, guard: DataFrame, id_col: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """ref without the ids of guard; the rows left out, with the reason."""
    ids = guard.select(text(id_col).alias("_id")).where("_id <> ''").distinct()
    same = text(id_col) == F.col("_id")
    return ref.join(ids, same, "left_anti"), ref.join(ids, same, "left_semi").withColumn("excluded_reason", F.lit(reason))


def evidence_index(df: DataFrame, keys: Sequence[str], fields: Sequence[str], row_no: str) -> DataFrame:
    """Per key the rows behind it and, for each field, its distinct values joined (capped)."""
    out = capped_lists(df.where(text(keys[-1]) != ""), keys, fields, F.col(row_no))
    return out.select(*keys, "hits", *(F.array_join(f, " | ").alias(f) for f in fields))


#: What to do about a row that has no match, by the guard that hit or the state of the row.
ACTIONS = {
    "missing": "complete the settlement or leave the content out",
    "service": "decide whether a settlement is made for the channel's content",
    "billing": "decide whether this is a billing case",
    "other_channel": "decide whether this channel needs a settlement",
    "master": "decide whether content and settlement are made for the channel",
    BLANK: "check the raw title or the cleaning rules",
    AMBIGUOUS: "choose the right id among the candidates",
    "other": "check the status and the reasons of the review",
    "none": "check whether the title is new or takes no settlement",
}


def explain_no_match(rows: DataFrame, guards: Sequence[tuple[str, DataFrame, Sequence[str], Sequence[str]]], status: str = "ref_status", key: str = "clean_key", channel: str | None = None) -> DataFrame:
    """Adds detail_reason, detail_evidence, detail_action, split_reason and <guard>_hits to rows that have no match; review_reason gets the split
    reasons too, and review follows it.

    guards: (name, evidence index, columns to join on, fields shown), in order of output. `service` is left out where `missing` hit; hits of
    `missing` and `billing` are split reasons of every row that isn't matched. `other_channel` is joined by key alone; the first of its fields
    holds its channels, of which those other than the row's own (column `channel`) are shown. It hits if there are any, or none is known.
    """
    out = rows
    open_ = F.col(status) != MATCHED
    hits: dict[str, Column] = {}
    shown: dict[str, Column] = {}
    for name, index, on, fields in guards:
        value = {f: F.coalesce(F.col(f"_{name}_{f}"), F.lit("")) for f in fields}
        mine = index.select(*on, F.col("hits").alias(f"_{name}_hits"), *(F.col(f).alias(f"_{name}_{f}") for f in fields))
        out = out.join(mine, list(on), "left")
        hits[name] = open_ & (F.coalesce(F.col(f"_{name}_hits"), F.lit(0)) > 0)
        if name == "other_channel" and channel:
            known = value[fields[0]]
            others = F.array_join(F.filter(F.split(known, r" \| "), lambda c: (c != "") & (c != text(channel))), " | ")
            hits[name] = hits[name] & ((known == "") | (others != ""))
            value[fields[0]] = others
        pieces = [F.when(v != "", F.concat(F.lit(f"{f}="), v)) for f, v in value.items()]
        shown[name] = F.concat(F.lit(f"{name}: "), F.array_join(F.array_compact(F.array(*pieces)), ", "))
    if "service" in hits and "missing" in hits:
        hits["service"] = hits["service"] & ~hits["missing"]
    joined = lambda by, names, sep: F.array_join(F.array_compact(F.array(*(F.when(hits[n], by(n)) for n in names))), sep)
    names = [n for n, *_ in guards]
    none = F.col(status) == NO_MATCH
    reason = joined(F.lit, names, " | ")
    split = joined(F.lit, [n for n in names if n in ("missing", "billing")], " | ")
    act = joined(lambda n: F.lit(ACTIONS.get(n, f"check {n}")), names, " | ")
    detail = F.when(~open_, "").when(F.col(status) == BLANK, "no key").when(~none, F.concat(F.lit("status "), F.col(status))).when(reason == "", "no candidate").otherwise(reason)
    proof = F.when(none & (reason != ""), joined(lambda n: shown[n], names, " || ")).when(none, F.concat(F.lit("key="), F.col(key))).otherwise("")
    todo = F.when(~open_, "").when(F.col(status) == BLANK, ACTIONS[BLANK]).when(F.col(status) == AMBIGUOUS, ACTIONS[AMBIGUOUS]).when(~none, ACTIONS["other"]).when(reason == "", ACTIONS["none"]).otherwise(act)
    counts = [F.when(hits[n], F.col(f"_{n}_hits")).otherwise(F.lit(0)).cast("long").alias(f"{n}_hits") for n in names]
    kept = [c for c in rows.columns if c not in ("review_reason", "review")]
    review = []
    if "review_reason" in rows.columns:
        why = F.when(split != "", append_reasons("review_reason", split)).otherwise(F.col("review_reason"))
        review = [why.alias("review_reason"), F.when(why != "", "Y").otherwise("N").alias("review")]
    return out.select(*kept, *review, detail.alias("detail_reason"), proof.alias("detail_evidence"), todo.alias("detail_action"), split.alias("split_reason"), *counts)


def other_channels(ref: DataFrame, key: str, channel: str, limit: int = LIST_LIMIT) -> DataFrame:
    """Per key the channels that hold it, as an array (capped one beyond, as the row's own may be among them)."""
    return capped_list(ref.where(text(key) != ""), [key], channel, text(channel), "channels", limit + 1).select(key, "channels")


def with_other_channels(rows: DataFrame, ref: DataFrame, key: str, channel: str, out: str = "other_channels") -> DataFrame:
    """The channels other than the row's own that hold its key: an equi-join on the key, then a filter of its array."""
    joined = rows.join(other_channels(ref, key, channel), key, "left")
    other = F.slice(F.filter("channels", lambda c: c != text(channel)), 1, LIST_LIMIT)
    return joined.select(*rows.columns, F.coalesce(F.array_join(other, " | "), F.lit("")).alias(out))


def transfer_gate(rows: DataFrame, policy_locked: bool, sale: str, base: str, offset: str, status: str = "ref_status", id_col: str = "ref_selected_id", count_col: str = "ref_id_count", split: str | None = "split_reason", blank_offset_as_zero: bool = False) -> DataFrame:
    """rows with block_reasons (array, in order) and the three amounts as numbers. Rows without a reason may be transferred.

    Columns that aren't there block every row.
    """
    absent = [c for c in (status, id_col, sale, base, offset) if c not in rows.columns]
    if absent:
        return rows.withColumn("block_reasons", F.array(F.lit("missing columns: " + ", ".join(absent)))).withColumns({n: F.lit(None).cast("double") for n in ("sale", "base", "offset")})
    zero = (text(offset) == "") if blank_offset_as_zero else F.lit(False)
    amount = F.when(zero, F.lit(0.0)).otherwise(amount_or_null(offset))
    reasons = [
        F.lit(None).cast("string") if policy_locked else F.lit("amount policy not locked"),
        F.when(text(status) != MATCHED, F.lit("not matched")),
        F.when(F.coalesce(F.col(count_col).cast("long"), F.lit(0)) > 1, F.lit("several candidates")) if count_col in rows.columns else F.lit(None).cast("string"),
        F.when(text(split) != "", F.lit("split reason")) if split and split in rows.columns else F.lit(None).cast("string"),
        F.when(text(id_col) == "", F.lit("no id")),
        F.when(amount_or_null(sale).isNull(), F.lit("sale not numeric")),
        F.when(amount_or_null(base).isNull(), F.lit("base not numeric")),
        F.when(amount.isNull(), F.lit("offset not numeric")),
    ]
    return rows.withColumns({"block_reasons": F.array_compact(F.array(*reasons)), "sale": amount_or_null(sale), "base": amount_or_null(base), "offset": amount})


def transfer_summary(gated: DataFrame, policy_locked: bool) -> DataFrame:
    """One row: rows to transfer, blocked rows, exportable (all or nothing)."""
    free = F.size("block_reasons") == 0
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return gated.agg(n(free).alias("transferable"), n(~free).alias("blocked")).withColumn("exportable", F.lit(policy_locked) & (F.col("transferable") > 0) & (F.col("blocked") == 0))


def rule_impact(before: DataFrame, after: DataFrame, row_ids: Sequence[str], status: str = "ref_status", groups: Sequence[str] = ()) -> DataFrame:
    """Rows whose status differs between two mappings of the same statements, counted by groups and both statuses."""
    b = after.select(*row_ids, F.col(status).alias("new_status"))
    changed = before.withColumnRenamed(status, "old_status").join(b, list(row_ids)).where("old_status <> new_status")
    return changed.groupBy(*groups, "old_status", "new_status").agg(F.count("*").alias("rows"))


def assign_channels(files: DataFrame, detected: str = "channel", platform: str = "platform", chosen: str = "") -> DataFrame:
    """Detected files with the channel that applies (chosen by hand for all, or detected) and a status."""
    status = F.lit("chosen") if chosen else F.when((text(detected) != "") & (text(platform) != ""), "ok").otherwise("choose")
    return files.withColumns({"applied": F.lit(chosen) if chosen else text(detected), "status": status})
