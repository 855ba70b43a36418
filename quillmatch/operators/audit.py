"""Targets from channel rules, file scope, run health, history views and the self-consistency check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.functions.text import contains_any, text
from quillmatch.operators.linkage import candidate_index, map_statements


def build_targets(rules: DataFrame, catalog: DataFrame, name: str = "channel", keys: Sequence[str] = ("platform", "channel_id", "partner")) -> tuple[DataFrame, DataFrame]:
    """rules(platform, channel) with the catalog's rows of that name (channel_id, partner, ...), one for each of keys; the rules without any."""
    found = rules.join(catalog, name)
    w = Window.partitionBy(*keys).orderBy(*(c for c in found.columns if c not in keys))
    targets = found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return targets, rules.join(catalog.select(name).distinct(), name, "left_anti")


def platform_filter(df: DataFrame, column: str, exact: Sequence[str] = (), include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Rows whose column is one of exact or contains a token of include, and contains none of exclude. Without rules all rows pass."""
    c = text(column)
    wanted = c.isin(list(exact)) | contains_any(c, include) if exact or include else F.lit(True)
    return df.where(wanted & ~contains_any(c, exclude) if exclude else wanted)


def channel_filter(df: DataFrame, column: str, channel: str) -> DataFrame:
    """Rows of one channel; all rows where the column is absent or no channel is given."""
    return df if not channel or column not in df.columns else df.where(text(column) == channel)


def channel_filter_audit(df: DataFrame, column: str, channel: str) -> DataFrame:
    """One row: rows before and after the filter, and why."""
    if not channel or column not in df.columns:
        return df.agg(F.count("*").alias("before"), F.count("*").alias("after"), F.lit("no channel" if not channel else "no column").alias("reason"))
    return df.agg(F.count("*").alias("before"), F.coalesce(F.sum((text(column) == channel).cast("long")), F.lit(0)).cast("long").alias("after"), F.lit("filtered").alias("reason"))


def file_status(files: DataFrame, name: str, excluded: Sequence[str], gated: Sequence[str], blocked: Sequence[str], platform: str = "platform") -> DataFrame:
    """file_status of each file: blocked platforms first, then name patterns (regular expressions), then platforms under review."""
    pattern = F.lit(False)
    for p in excluded:
        pattern = pattern | F.col(name).rlike(p)
    status = F.when(F.col(platform).isin(list(blocked)), "blocked_source").when(pattern, "excluded_by_rule").when(F.col(platform).isin(list(gated)), "review_gate_not_default").otherwise("include")
    return files.withColumn("file_status", status)


def health(runs: DataFrame, tables: DataFrame, now: Column, stale_hours: int = 12) -> DataFrame:
    """Per table of tables(name, rows): hours since its latest successful run, drift of its row count from that run's, and warnings.

    runs(run_id, name, status, finished, rows).
    """
    good = runs.where("status = 'success'").groupBy("name").agg(F.max("finished").alias("finished"), F.max_by("rows", F.struct("finished", "run_id")).alias("logged"))
    last = runs.groupBy("name").agg(F.max_by("status", "run_id").alias("last_status"))
    out = tables.join(good, "name", "left").join(last, "name", "left")
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp("finished")) / 3600)
    out = out.withColumns({"hours": hours, "drift": F.col("rows") - F.col("logged")})
    warnings = F.array(F.when(F.col("finished").isNull(), "never refreshed"), F.when(F.col("hours") >= stale_hours, "stale"), F.when(F.col("drift") != 0, "row count differs"), F.when(F.col("last_status") == "failed", "last run failed"))
    return out.select("name", "rows", "hours", "drift", F.array_join(F.array_compact(warnings), " | ").alias("warnings"))


def latest_runs(runs: DataFrame, n: int) -> DataFrame:
    """The n runs of greatest id, a view for a page: n is the page's length."""
    return runs.orderBy(F.desc("run_id")).limit(n)


def self_check(stmt: DataFrame, key: str, title: str, row_no: str) -> DataFrame:
    """Statements mapped to a reference made of their own distinct keys: every row with a key must match. -> rows, matched, blank."""
    ref = stmt.where(text(key) != "").groupBy(key).agg(F.min(title).alias("title"), F.min(row_no).alias("n"))
    index = candidate_index(ref.withColumn("id", F.sha2(key, 256)), [key], "id", "title", "n")
    n = lambda s: F.coalesce(F.sum((F.col("ref_status") == s).cast("long")), F.lit(0)).cast("long")
    return map_statements(stmt, index, [key]).agg(F.count("*").alias("rows"), n("matched").alias("matched"), n("blank_key").alias("blank"))


def platform_rollup(files: DataFrame, dim: DataFrame, key: str, sums: Sequence[str], error: str) -> DataFrame:
    """Per platform of dim: files, sums, up to 3 distinct errors and a status."""
    errors = files.where(text(error) != "").select(key, text(error).alias("e")).distinct()
    w = Window.partitionBy(key).orderBy("e")
    errors = errors.withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("e")), " | ").alias("errors"))
    totals = files.groupBy(key).agg(F.count("*").alias("files"), *(F.sum(c).alias(c) for c in sums))
    out = dim.select(key).distinct().join(totals, key, "left").join(errors, key, "left").na.fill(0).na.fill("", ["errors"])
    return out.withColumn("status", F.when(F.col("files") == 0, "no files").when(F.col("errors") != "", "errors").otherwise("ok"))


#: The states of a sheet, worst first.
SHEET_STATES = ("unreadable", "header_not_found", "no_data", "parsed", "excluded_sheet", "excluded_by_rule")
PARSED, FAILED = "parsed", ("unreadable", "header_not_found")
CAUSES = 3


def worst_states(df: DataFrame, keys: Sequence[str], state: str, cause: str, states: Sequence[str] = SHEET_STATES) -> DataFrame:
    """keys, state (the worst of the group, by its place in states), causes: of the failed states the first CAUSES by text, "state: cause".

    The worst is a minimum, the causes are ranked before they are gathered: both are made from parts, and neither grows with the group.
    """
    place = F.array_position(F.array(*map(F.lit, states)), F.col(state))
    worst = df.groupBy(*keys).agg(F.min(F.struct(place.alias("p"), F.col(state).alias("s"))).alias("__w"))
    why = df.where(F.col(state).isin(list(FAILED))).select(*keys, F.concat(F.col(state), F.lit(": "), text(cause)).alias("__c")).distinct()
    ranked = why.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("__c"))).where(F.col("__r") <= CAUSES)
    listed = ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("__c")), " | ").alias("causes"))
    return worst.join(listed, list(keys), "left").select(*keys, F.col("__w.s").alias(state), F.coalesce("causes", F.lit("")).alias("causes"))


def file_states(sheets: DataFrame, rows: DataFrame) -> DataFrame:
    """Sheet audits and statement rows, as normalize_statements() gives them, by file: platform, source_file, status (the worst of its sheets), causes, parsed_rows,
    feed_rows (rows of included files)."""
    made = sheets.groupBy("platform", "source_file").agg(F.sum("parsed_rows").alias("parsed_rows"))
    fed = rows.where("file_status = 'include'").groupBy("source_file").agg(F.count("*").alias("feed_rows"))
    worst = worst_states(sheets, ["platform", "source_file"], "status", "sheet")
    return worst.join(made, ["platform", "source_file"]).join(fed, "source_file", "left").na.fill(0, ["feed_rows"])


def platform_audit(files: DataFrame, rows: DataFrame, registry: DataFrame, blocked_class: str = "non_s2_source_blocked", locked: str = "candidate_confirmed_after_reconcile") -> DataFrame:
    """A row a platform of registry(platform, final_class, amount_rule_status, ...): files, parsed_rows, feed_rows, materialisation, projection, the check of its
    feed against itself (check: pass, pass_with_review or skipped; checked and matched rows) and the first causes of failure.

    files: file_states(); rows: statement rows with clean_key. Platforms without files are there too.
    """
    totals = files.groupBy("platform").agg(F.count("*").alias("files"), F.sum("parsed_rows").alias("parsed_rows"), F.sum("feed_rows").alias("feed_rows"))
    failed = files.where(F.col("status").isin(list(FAILED))).select("platform", F.col("status"), F.concat("source_file", F.lit(" "), "causes").alias("why"))
    why = worst_states(failed, ["platform"], "status", "why").select("platform", "causes")
    fed = rows.where("file_status = 'include'")
    own = fed.where(text("clean_key") != "").select("platform", "clean_key").distinct().withColumn("__in", F.lit(True))
    counted = fed.groupBy("platform", "clean_key").agg(F.count("*").alias("__n"))  # by key first: a key of many rows is joined as one
    found = F.when(F.col("__in"), F.col("__n")).otherwise(0)
    checked = counted.join(own, ["platform", "clean_key"], "left").groupBy("platform").agg(F.sum("__n").alias("checked"), F.sum(found).alias("matched"))
    out = registry.select("platform", (F.col("final_class") == blocked_class).alias("__b"), (F.col("amount_rule_status") == locked).alias("__l")).join(totals, "platform", "left")
    out = out.join(why, "platform", "left").join(checked, "platform", "left").na.fill(0).na.fill("", ["causes"])
    state = (
        F.when(F.col("files") == 0, "no_period_source").when((F.col("causes") != "") & (F.col("feed_rows") == 0), "parse_failed").when(F.col("__b"), "materialized_but_blocked_from_default_feed")
        .when(F.col("feed_rows") > 0, "materialized_default_feed").otherwise("parsed_no_default_feed")
    )
    project = F.when(F.col("__b"), "s2_projection_blocked_non_s2_source").when(F.col("__l"), "s2_projection_candidate_after_policy").otherwise("s2_projection_blocked_by_amount_or_policy")
    check = F.when(F.col("checked") == 0, "skipped_no_default_feed").when(F.col("matched") == F.col("checked"), "pass_after_substitution").otherwise("pass_with_review")
    return out.select("platform", "files", "parsed_rows", "feed_rows", state.alias("materialisation"), project.alias("projection"), check.alias("check"), "checked", "matched", "causes")


#: Platforms whose channels depend on words in the file's name, by first match, and the channels each then takes.
NAME_RULES = [
    ("네이버", ["광고", "장르"], ["네이버_장르(광고수익)"]),
    ("네이버", ["광고", "연재"], ["네이버_연재(광고수익)"]),
    ("네이버", ["장르"], ["네이버_장르"]),
    ("네이버", ["연재"], ["네이버_연재"]),
    ("네이버", ["일반"], ["네이버_일반"]),
    ("네이버", [], ["네이버_장르", "네이버_연재", "네이버_일반"]),
    ("문피아", ["후원"], ["문피아(후원금 정산)"]),
    ("리디북스", ["이벤트"], ["리디북스(이벤트)"]),
    ("카카오", ["선투자"], ["카카오페이지(선투자)"]),
    ("카카오", ["창작지원금"], ["카카오페이지(창작지원금)"]),
    ("카카오", [], ["카카오페이지(소설)"]),
]


def name_rules(spark: SparkSession) -> DataFrame:
    """NAME_RULES as a table; rules of other platforms (no tokens, all their channels) are added to it from the channel rules."""
    rows = [(p, t, c, [], [], i) for i, (p, t, c) in enumerate(NAME_RULES)]
    return spark.createDataFrame(rows, "platform string, tokens array<string>, exact array<string>, include array<string>, exclude array<string>, pos int")


def choose_rule(files: DataFrame, rules: DataFrame, name: str, platform: str = "platform") -> DataFrame:
    """files with the rule of their platform that comes first by pos and whose tokens are all in the name without its spaces; null where there is none.

    rules(platform, tokens, exact, include, exclude, pos) has a few rows a platform, gathered by platform and joined once.
    """
    known = rules.groupBy(F.col("platform").alias("_p")).agg(F.array_sort(F.collect_list(F.struct("pos", "tokens", "exact", "include", "exclude"))).alias("_rules"))
    bare = F.replace(text(name), F.lit(" "), F.lit(""))
    fits = F.filter("_rules", lambda r: F.forall(r["tokens"], lambda t: F.contains(bare, t)))
    out = files.join(known, text(platform) == F.col("_p"), "left").withColumn("_rule", F.try_element_at(fits, F.lit(1)))
    return out.select(*files.columns, "_rule.exact", "_rule.include", "_rule.exclude", F.col("_rule").isNotNull().alias("active"))


def channels_for(chosen: DataFrame, file: str, channels: DataFrame, channel: str) -> DataFrame:
    """file, channel: the channels of a table of distinct channels that each file's rule lets pass; all of them where no rule applies."""
    table = channels.select(text(channel).alias("c")).where("c <> ''").agg(F.collect_set("c")).scalar()
    cols = ["exact", "include", "exclude", "active"]
    rules = chosen.select(*(F.col(c).alias(f"_{c}") for c in cols)).distinct().withColumn("_c", table)
    passes = lambda c: (F.array_contains("_exact", c) | F.exists("_include", lambda t: F.contains(c, t))) & ~F.exists("_exclude", lambda t: F.contains(c, t))
    rules = rules.withColumn("_c", F.when(F.col("_active"), F.filter("_c", passes)).otherwise(F.col("_c")))
    return chosen.join(rules, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols]).select(file, F.explode("_c").alias(channel))


def history_view(runs: DataFrame, names: Mapping[str, str], labels: Mapping[str, Mapping[str, str]], n: int) -> DataFrame:
    """The n latest runs under the names of a page, with values relabelled; columns that runs lacks are left out, unknown values stay."""

    def shown(c: str) -> Column:
        value = F.col(c)
        for old, new in labels.get(c, {}).items():
            value = F.when(F.col(c) == old, F.lit(new)).otherwise(value)
        return value.alias(names[c])

    return latest_runs(runs, n).select(*(shown(c) for c in names if c in runs.columns))
