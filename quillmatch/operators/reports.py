"""Reports over mapped statements: work orders, roll-ups, reconciliation, coverage gaps, backfill candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmatch.functions.text import numeric_sum, numeric_zero, pipe_ids, text, unique_list
from quillmatch.operators.linkage import capped_list, capped_lists
from quillmatch.operators.ranks import global_rank


def combined_report(rows: DataFrame, columns: Sequence[str], status: str, order: Sequence[str]) -> DataFrame:
    """The columns (absent ones blank), by status descending and then in order."""
    have = [F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
    return rows.orderBy(F.desc(status), *order).select(*have)


def work_order(rows: DataFrame, keys: Sequence[str], order: str, lists: Sequence[str], firsts: Sequence[str] = ()) -> DataFrame:
    """One row a group of keys: first_no (place of its first row), group_size, the first value of `firsts`, distinct values of `lists` in
    order (capped, joined). Groups are pre-aggregated, lists ranked before they are gathered."""
    base = rows.groupBy(*keys).agg(F.min(order).alias("first_no"), F.count("*").alias("group_size"), *(F.min_by(f, order).alias(f) for f in firsts))
    if lists:
        made = capped_lists(rows.withColumns({f"{c}_list": F.col(c) for c in lists}), keys, [f"{c}_list" for c in lists], F.col(order)).drop("hits")
        base = base.join(made, [base[k].eqNullSafe(made[k]) for k in keys]).drop(*(made[k] for k in keys))
    return base.select(*keys, "first_no", "group_size", *firsts, *(F.array_join(f"{c}_list", " | ").alias(f"{c}_list") for c in lists))


def batch_summary(rows: DataFrame, file: str, status: str = "ref_status", review: str = "review", by: Sequence[str] = ()) -> DataFrame:
    """Per file (and what else `by` names): rows, matched ones, unmatched ones, ones to review."""
    n = lambda c, a: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(a)
    return rows.groupBy(*by, file).agg(F.count("*").alias("rows"), n(F.col(status) == "matched", "matched"), n(F.col(status) == "no_match", "no_match"), n(F.col(review) == "Y", "to_review"))


def reconcile(dim: DataFrame, a: DataFrame, b: DataFrame, key: str, amounts: Sequence[str], tolerance: float = 1.0) -> DataFrame:
    """Per member of dim: rows and sums on both sides, deltas and a status. Amounts may be text."""
    side = lambda df, p: df.groupBy(key).agg(F.count("*").alias(f"{p}_rows"), *(F.round(numeric_sum(c), 2).alias(f"{p}_{c}") for c in amounts))
    out = dim.select(key).distinct().join(side(a, "a"), key, "left").join(side(b, "b"), key, "left").na.fill(0)
    out = out.withColumns({f"delta_{c}": F.round(F.col(f"a_{c}") - F.col(f"b_{c}"), 2) for c in amounts})
    near = F.lit(True)
    for c in amounts:
        near = near & (F.abs(f"delta_{c}") < tolerance)
    status = F.when((F.col("a_rows") == 0) & (F.col("b_rows") == 0), "absent").when(F.col("a_rows") == 0, "only_b").when(F.col("b_rows") == 0, "only_a").when(near, F.when(F.col("a_rows") == F.col("b_rows"), "equal").otherwise("amounts_equal")).otherwise("differs")
    return out.withColumn("status", status)


def coverage_gap(service: DataFrame, lookup: DataFrame, samples: DataFrame, id_col: str, key: str, file: str, disabled: str) -> DataFrame:
    """service rows with paid (Y/N), sample_files (10 at most, sorted) and a grade: disabled, in samples without payment, without payment, paid."""
    paid = lookup.where(text(id_col) != "").select(id_col).distinct().withColumn("_p", F.lit("Y"))
    seen = capped_list(samples.where(text(key) != ""), [key], file, text(file), "files", 10).select(key, "files")
    out = service.join(paid, id_col, "left").join(seen, key, "left")
    yes = F.coalesce("_p", F.lit("N"))
    grade = F.when(text(disabled) == "Y", "C_DISABLED").when(yes == "Y", "OK_PAID").when(F.col("files").isNotNull(), "A_SEEN_WITHOUT_PAYMENT").otherwise("B_WITHOUT_PAYMENT")
    return out.select(*service.columns, yes.alias("paid"), F.array_join(F.coalesce("files", F.array()), " | ").alias("sample_files"), grade.alias("grade"))


#: What to do about each grade.
GRADE_ACTIONS = {
    "A_SEEN_WITHOUT_PAYMENT": "candidate for a missing-payment suffix; no automatic match before its payment is set up",
    "B_WITHOUT_PAYMENT": "keep under audit; becomes a candidate when a statement shows it",
    "C_DISABLED": "block before matching",
    "OK_PAID": "usable",
}


def coverage_judgement(service: DataFrame, lookup: DataFrame, samples: DataFrame, id_col: str, key: str, file: str, disabled: str, row_no: str, shown: Sequence[str] = ()) -> DataFrame:
    """coverage_gap() with action, in_samples (Y/N) and paid_<column> for the columns shown of the lookup: those of its first row (by row_no) of the id, "" where it
    has none."""
    first = lookup.where(text(id_col) != "").groupBy(id_col).agg(*(F.min_by(text(c), row_no).alias(f"paid_{c}") for c in shown)) if shown else None
    out = coverage_gap(service, lookup, samples, id_col, key, file, disabled)
    action = F.coalesce(*(F.when(F.col("grade") == g, F.lit(a)) for g, a in GRADE_ACTIONS.items()))
    out = out.withColumns({"action": action, "in_samples": F.when(F.col("sample_files") != "", "Y").otherwise("N")})
    if first is None:
        return out
    return out.join(first, id_col, "left").na.fill("", [f"paid_{c}" for c in shown]).select(*out.columns, *(f"paid_{c}" for c in shown))


def coverage_summary(judged: DataFrame, by: str) -> DataFrame:
    """Rows of the judgement by `by` and grade, and over all (by ""), in one pass."""
    each = F.array(F.struct(F.lit(False).alias("total"), text(by).alias("v")), F.struct(F.lit(True).alias("total"), F.lit("").alias("v")))
    long = judged.select("grade", F.explode(each).alias("x"))
    return long.groupBy(F.col("x.v").alias(by), F.col("x.total").alias("total"), "grade").agg(F.count("*").alias("n"))


def grade_pivot(graded: DataFrame, by: str) -> DataFrame:
    grades = ["A_SEEN_WITHOUT_PAYMENT", "B_WITHOUT_PAYMENT", "C_DISABLED", "OK_PAID"]
    return graded.groupBy(by).pivot("grade", grades).count().select(by, *(F.coalesce(F.col(g), F.lit(0)).cast("long").alias(g.lower()) for g in grades))


def safe_candidates(rows: DataFrame, reason: str, master_ids: DataFrame, special: Sequence[str], channel: str, label: str = "id", evidence: str = "detail_evidence", detail: str = "detail_reason", guard: str = "", counts: Sequence[str] = ()) -> DataFrame:
    """Rows of exactly this reason: content_id if the evidence names one that the master has, and why others are excluded ("" if safe; else the first
    of: special channel, not one content, not in master, a guard's count).

    guard: only that guard's section of the evidence counts; all sections if empty. counts: columns with the number of hits of guards, which must be 0
    or blank; those that rows lack are passed over.
    """
    sections = F.filter(F.split(evidence, r" \|\| "), lambda s: s.startswith(f"{guard}: " if guard else ""))
    rows = rows.withColumn(evidence, F.array_join(sections, " || "))
    ids = F.array_distinct(pipe_ids(evidence, label))
    known = master_ids.select(text(master_ids.columns[0]).alias("content_id")).distinct().withColumn("_m", F.lit(True))
    out = rows.where(F.col(detail) == reason).withColumn("_ids", ids).withColumn("content_id", F.when(F.size("_ids") == 1, F.col("_ids")[0]).otherwise(F.lit("")))
    out = out.join(known, "content_id", "left")
    why = F.when(F.col(channel).isin(list(special)), "special channel").when(F.size("_ids") != 1, "not one content").when(F.col("_m").isNull(), "not in master")
    for c in (c for c in counts if c in rows.columns):
        why = why.when(~numeric_zero(c), F.concat(F.lit(f"{c}="), text(c)))
    why = why.otherwise("")
    return out.withColumn("excluded_because", why).drop("_ids", "_m")


def reflection(added: DataFrame, rows: DataFrame, on: Sequence[str], id_col: str, found: str) -> DataFrame:
    """Per added (channel, key, id): rows of the re-run, its distinct ids, whether the id is among them."""
    again = rows.groupBy(*on).agg(F.count("*").alias("rerun_rows"), F.count_distinct(F.nullif(text(found), F.lit(""))).alias("rerun_ids"))
    hit = rows.select(*on, text(found).alias("_f")).distinct()
    out = added.join(again, list(on), "left").join(hit.withColumn("_y", F.lit("Y")), [*(added[c] == hit[c] for c in on), text(id_col) == hit["_f"]], "left")
    return out.select(*(added[c] for c in added.columns), F.coalesce("rerun_rows", F.lit(0)).alias("rerun_rows"), F.coalesce("rerun_ids", F.lit(0)).alias("rerun_ids"), F.coalesce("_y", F.lit("N")).alias("reflected"))


def header_signatures(cells: DataFrame, sheet: str, order: str, value: str) -> DataFrame:
    """Sheets by their ordered distinct headers: signature, sheets, an example."""
    first = cells.groupBy(sheet, text(value).alias("_v")).agg(F.min(F.struct(F.col(order).alias("o"))).alias("_o"))  # gathered: a row a header
    signed = first.withColumn("_o", F.col("_o.o")).groupBy(sheet).agg(F.array_join(unique_list("_v", "_o"), " > ").alias("signature"))
    return signed.groupBy("signature").agg(F.count("*").alias("sheets"), F.min(sheet).alias("example"))


def schema_clusters(cells: DataFrame, sheet: str, order: str, value: str) -> DataFrame:
    """header_signatures() with their rank by size."""
    return global_rank(header_signatures(cells, sheet, order, value), [F.desc("sheets"), F.col("signature")])
