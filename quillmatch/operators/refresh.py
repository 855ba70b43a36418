"""Replacing the lookup by a new snapshot: latest rows, conflicts, profile, diff and change log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions.text import excel_date, id_text, text
from quillmatch.functions.titles import add_master_title, drop_disabled
from quillmatch.sources.io import append_changes, append_run
from quillmatch.sources.versions import read_table, replace_table, versions


def latest_per_id(df: DataFrame, id_col: str, date: str, row_no: Sequence[str | Column]) -> DataFrame:
    """One row for each id that isn't blank: the greatest date text (blank last), then input order."""
    w = Window.partitionBy(id_col).orderBy(F.nullif(text(date), F.lit("")).desc_nulls_last(), *row_no)
    return df.where(text(id_col) != "").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def conflict_counts(df: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """One row: ids with several rows, and with several values of each column."""
    per = df.where(text(id_col) != "").groupBy(id_col).agg(F.count("*").alias("rows"), *(F.count_distinct(F.nullif(text(c), F.lit(""))).alias(c) for c in columns))
    return per.agg(*(F.coalesce(F.sum(F.when(F.col(c) > 1, 1).otherwise(0)), F.lit(0)).cast("long").alias(f"several_{c}") for c in ("rows", *columns)))


def profile(df: DataFrame, counted: Sequence[str], dated: str) -> DataFrame:
    """item, value: rows, columns, non-blank and distinct values of the counted columns, first and last date. One pass."""
    items: dict[str, Column] = {"rows": F.count("*").cast("string"), "columns": F.lit(str(len(df.columns)))}
    for c in counted:
        items[f"{c} filled"] = F.sum(F.when(text(c) != "", 1).otherwise(0)).cast("string")
        items[f"{c} distinct"] = F.count_distinct(F.nullif(text(c), F.lit(""))).cast("string")
    items["first date"], items["last date"] = F.min(F.nullif(text(dated), F.lit(""))), F.max(text(dated))
    wide = df.agg(*(v.alias(f"c{i}") for i, v in enumerate(items.values())))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("item"), F.coalesce(F.col(f"c{i}"), F.lit("0")).alias("value")) for i, k in enumerate(items)))).alias("x")).select("x.*")


def value_counts(df: DataFrame, column: str, limit: int | None = None, blank: str | None = "(blank)") -> DataFrame:
    """value, n, most frequent first (ties by value); blank None: blanks are left out. limit is the report's length."""
    value = text(column)
    rows = df.select(F.when(value == "", F.lit(blank)).otherwise(value).alias("value")).where("value is not null")
    out = rows.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")
    return out if limit is None else out.limit(limit)


def scope_existing(old: DataFrame, new: DataFrame, shape: str) -> DataFrame:
    """Rows of old whose shape occurs in new; all of old if new has no shapes."""
    shapes = new.where(text(shape) != "").select(text(shape).alias("_s")).distinct()
    some = shapes.agg((F.count("*") > 0).alias("any")).scalar()
    return old.join(shapes.withColumn("_in", F.lit(True)), text(shape) == F.col("_s"), "left").where(F.coalesce("_in", F.lit(False)) | ~some).drop("_s", "_in")


def snapshot_diff(old: DataFrame, new: DataFrame, id_col: str, fields: Sequence[str]) -> DataFrame:
    """id, change (added, deleted, modified), changed_fields (array), old_<f>, new_<f>; unchanged ids are left out.

    Both sides have one row an id (latest_per_id); blank and null fields are the same.
    """
    side = lambda df, p: df.where(text(id_col) != "").select(id_text(id_col).alias(id_col), F.lit(True).alias(f"_{p}"), *(text(f).alias(f"{p}_{f}") for f in fields))
    both = side(old, "old").join(side(new, "new"), id_col, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(F.size(changed) > 0, "modified")
    return both.select(id_col, change.alias("change"), F.when(change == "modified", changed).otherwise(F.array().cast("array<string>")).alias("changed_fields"), *(f"{p}_{f}" for f in fields for p in ("old", "new"))).where("change is not null")


def change_summary(diff: DataFrame) -> DataFrame:
    n = lambda k: F.coalesce(F.sum(F.when(F.col("change") == k, 1).otherwise(0)), F.lit(0)).cast("long").alias(k)
    return diff.agg(n("added"), n("deleted"), n("modified"))


def change_feed(changes: DataFrame, runs: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Changes of the latest successful run: modified, added, deleted, then by id; limit (5,000 at most) is the report's length."""
    latest = runs.where("status = 'success'").agg(F.max("run_id").alias("m")).scalar()
    rank = F.when(F.col("change") == "modified", 0).when(F.col("change") == "added", 1).otherwise(2)
    return changes.where(F.col("run_id") == latest).withColumn("rank", rank).orderBy("rank", id_col).limit(min(limit, 5000))


def compare_ids(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """One row: ids in both, only in a, only in b, equal."""
    ids = lambda df, n: df.where(text(id_col) != "").select(id_text(id_col).alias("i")).distinct().withColumn(n, F.lit(1))
    both = ids(a, "x").join(ids(b, "y"), "i", "full_outer")
    n = lambda c, name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    x, y = F.col("x").isNotNull(), F.col("y").isNotNull()
    return both.agg(n(x & y, "overlap"), n(x & ~y, "only_a"), n(y & ~x, "only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


#: A column is an author's if its name holds one of these.
AUTHOR_TOKENS = ("작가", "저자", "author", "writer")


def normalize_frame(df: DataFrame) -> DataFrame:
    """Rows with a value in any column; headers trimmed, white space inside them one space."""
    return df.toDF(*(" ".join(c.split()) for c in df.columns)).dropna("all")


def audit_snapshot(df: DataFrame, id_col: str, date: str, row_no: Sequence[str | Column], title: str, ids: Sequence[str]) -> DataFrame:
    """The latest row of each id, reduced to what a diff compares: title (a master's title reduced to the work), ids, authors (distinct values of all
    author columns, joined). Columns that df lacks are ""."""
    authors = [c for c in df.columns if any(t in c.lower() for t in AUTHOR_TOKENS)]
    rows = df.withColumn(id_col, id_text(id_col))
    rows = latest_per_id(rows.withColumn("_d", excel_date(date) if date in df.columns else F.lit("")), id_col, "_d", row_no)
    out = add_master_title(rows, title, "_title") if title in df.columns else rows.withColumn("_title", F.lit(""))
    values = F.array_distinct(F.filter(F.array(*(text(F.col(f"`{c}`")) for c in authors)), lambda v: v != "")) if authors else F.array().cast("array<string>")
    return out.select(id_col, text("_title").alias("title"), *((id_text(c) if c in df.columns else F.lit("")).alias(c) for c in ids), F.array_join(values, " | ").alias("authors"))


class Refreshed(NamedTuple):
    lookup: DataFrame
    changes: DataFrame
    summary: DataFrame
    conflicts: DataFrame


def refresh_lookup(old: DataFrame, new: DataFrame, id_col: str, date: str, row_no: Sequence[str | Column], title: str, ids: Sequence[str], shape: str | None = None, mode: str = "full") -> Refreshed:
    """A lookup replaced whole by a new export: the new lookup (rows without a disabled marker, latest of each id), its changes against the old one
    within the shapes that the export has, their summary, and how often ids conflict. Merging isn't defined."""
    if mode != "full":
        raise ValueError(f"a lookup is replaced whole, not by mode {mode}")
    rows = drop_disabled(normalize_frame(new))
    was = old if shape is None else scope_existing(old, rows, shape)
    fields = ["title", *ids, "authors"]
    changes = snapshot_diff(audit_snapshot(drop_disabled(was), id_col, date, row_no, title, ids), audit_snapshot(rows, id_col, date, row_no, title, ids), id_col, fields)
    return Refreshed(latest_per_id(rows, id_col, date, row_no), changes, change_summary(changes), conflict_counts(rows, id_col, [title, *ids]))


RUNS = "run_id string, status string, mode string, version long, added long, deleted long, modified long, message string"


def replace_lookup(new: DataFrame, path: str, log: str, run_id: str, id_col: str, date: str, row_no: Sequence[str | Column], title: str, ids: Sequence[str], shape: str | None = None, mode: str = "full") -> int:
    """refresh_lookup() of the table at path (see versions), logged below log: runs gets a row, whether the refresh goes well or not, changes the
    changes. -> the new version.

    The new lookup is made against the version that is the latest at the beginning and becomes the next one; where another refresh has got
    in between, nothing is replaced and the run is logged as failed. The first refresh has all ids added.
    """
    spark = new.sparkSession

    def logged(status: str, version: int | None, counts: Sequence[int | None], message: str) -> None:
        append_run(spark.createDataFrame([(run_id, status, mode, version, *counts, message)], RUNS), f"{log}/runs")

    try:
        there = versions(spark, path)
        old = read_table(spark, path, there[-1]) if there else normalize_frame(new).limit(0)
        made = refresh_lookup(old, new, id_col, date, row_no, title, ids, shape, mode)
        version = replace_table(made.lookup, path, based_on=there[-1] if there else 0)
        append_changes(made.changes, f"{log}/changes", F.lit(run_id))
        done = spark.read.parquet(f"{log}/changes").where(F.col("run_id") == run_id)
        logged("success", version, tuple(change_summary(done).first()), "")
    except Exception as e:
        logged("failed", None, (None, None, None), f"{type(e).__name__}: {str(e)[:500]}")
        raise
    return version


def split_master(df: DataFrame, required: Sequence[str], owner: str, owned_by: str, shape: str, classes: Mapping[str, str]) -> DataFrame:
    """Rows of one owner with a value in a required column, by class: classes maps a shape to its name, other shapes are "other". write_by_class
    writes them."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError("the master lacks columns: " + ", ".join(absent))
    rows = df.select(*required).dropna("all").where(text(owner) == owned_by)
    name = F.coalesce(*(F.when(text(shape) == s, F.lit(c)) for s, c in classes.items()), F.lit("other"))
    return rows.withColumn("class", name)
