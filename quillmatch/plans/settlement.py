"""Gate, refresh and report queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import gates as G
from quillmatch.operators import refresh as R
from quillmatch.operators import reports as P
from quillmatch.plans import linkage
from quillmatch.plans.linkage import ROW, Keys, keyed_parts, table


def judged(spark, sf_dir):
    """Orders as contents of customers: paid if a line came back, disabled by priority."""
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey").distinct().withColumn("r", F.lit("Y"))
    o = table(spark, sf_dir, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    rows = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("content"), F.coalesce("r", F.lit("N")).alias("paid"), F.when(F.col("o_orderpriority") == "1-URGENT", "Y").otherwise("N").alias("disabled"))
    depts = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("content"), F.col("c_mktsegment").alias("department"), F.col("c_custkey").alias("row_no"))
    return G.status_table(rows, "id", "content", "paid", "disabled", "2026-05-09", depts)


def status_table(spark, sf_dir):
    return judged(spark, sf_dir).select("id", "content", "paid", "disabled", "department", "mixed_risk", "status", "as_of")


def gate_rows(spark, sf_dir, mode):
    lines = table(spark, sf_dir, "lineitem").select(*ROW).withColumn("id", F.concat(F.col("l_orderkey").cast("string"), F.when(F.col("l_orderkey") % 2 == 0, F.lit(".0")).otherwise(F.lit(""))))
    return G.apply_gate(lines, judged(spark, sf_dir).where("department <> 'BUILDING'"), "id", "id", mode)


def gate_allowed(spark, sf_dir):
    return gate_rows(spark, sf_dir, "strict").allowed.select(*ROW, "gate_status")


def gate_blocked(spark, sf_dir):
    return gate_rows(spark, sf_dir, "strict").blocked.select(*ROW, "gate_status")


def gate_audit(spark, sf_dir):
    return gate_rows(spark, sf_dir, "audit_only").allowed.groupBy("gate_status").agg(F.count("*").alias("n"))


def gate_summary(spark, sf_dir):
    return G.gate_summary(judged(spark, sf_dir), "id", "content", "paid")


def status_by_department(spark, sf_dir):
    return G.status_by_department(judged(spark, sf_dir), ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "NONE"])


def only_blocked_alerts(spark, sf_dir):
    k = Keys(spark, sf_dir)
    p = keyed_parts(k).withColumn("k", F.concat("clean_key", "p_brand"))
    stmt = table(spark, sf_dir, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "k"), "l_partkey")
    return G.only_blocked_alerts(stmt, p.where("p_size > 20").select("k"), p.where("p_size <= 20").select("k"), "k").select(*ROW, "k", "blocked_rows")


def blocked_title_hits(spark, sf_dir):
    k = Keys(spark, sf_dir)
    p = keyed_parts(k).withColumn("k", F.concat("clean_key", "p_brand"))
    stmt = table(spark, sf_dir, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "k"), "l_partkey")
    return G.blocked_title_hits(stmt.select(*ROW, "k"), p.where("p_size <= 5").select("k", F.col("p_partkey").alias("blocked_id")), "k").select(*ROW, "k", "blocked_id")


def latest_lookup(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("d", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return R.latest_per_id(e, "user_id", "d", ["event_id"]).select("user_id", "event_id", "event_type")


def conflict_counts(spark, sf_dir):
    return R.conflict_counts(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])


def profile(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return R.profile(o, ["o_custkey", "o_orderstatus"], "d")


def value_counts(spark, sf_dir):
    return R.value_counts(table(spark, sf_dir, "events"), "event_type")


def snapshots(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 1")
    new = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 2").withColumn("c_name", F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))).withColumn("c_mktsegment", F.when(F.col("c_custkey") % 11 == 0, F.lit("NEW")).otherwise(F.col("c_mktsegment")))
    return R.snapshot_diff(old, new, "c_custkey", ["c_name", "c_mktsegment"])


def snapshot_diff(spark, sf_dir):
    return snapshots(spark, sf_dir).select("c_custkey", "change", F.array_join("changed_fields", ",").alias("changed_fields"), "old_c_name", "new_c_name")


def change_summary(spark, sf_dir):
    return R.change_summary(snapshots(spark, sf_dir))


def change_feed(spark, sf_dir):
    runs = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("run_id"), F.when(F.col("r_regionkey") == 4, "failed").otherwise("success").alias("status"))
    changes = snapshots(spark, sf_dir).withColumn("run_id", F.col("c_custkey").cast("int") % 5)
    return R.change_feed(changes, runs, "c_custkey", 50).select("c_custkey", "change")


def compare_ids(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return R.compare_ids(a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id")


def work_order(spark, sf_dir):
    k = Keys(spark, sf_dir)
    rows = linkage.explained(k).where("review = 'Y'").withColumn("no", F.col("l_orderkey") * 10**9 + F.col("l_partkey") * 10**4 + F.col("l_suppkey") * 10 + F.col("l_linenumber"))
    return P.work_order(rows, ["p_brand", "clean_key", "detail_reason"], "no", ["l_orderkey"], ["review_reason"]).select("p_brand", "clean_key", "detail_reason", "first_no", "group_size", "review_reason", F.md5("l_orderkey_list").alias("orders_md5"))


def combined_report(spark, sf_dir):
    k = Keys(spark, sf_dir)
    rows = linkage.explained(k)
    return P.combined_report(rows, [*ROW, "ref_status", "detail_reason", "note"], "ref_status", ROW)


def batch_summary(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return P.batch_summary(linkage.mapped(k), "p_brand")


def reconcile_amounts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_suppkey").cast("string"))
    b = l.where("l_suppkey % 5 <> 1").withColumn("l_quantity", F.when(F.col("l_suppkey") % 5 == 2, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    dim = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("s"))
    return P.reconcile(dim, l, b, "s", ["l_quantity"])


def graded(spark, sf_dir):
    k = Keys(spark, sf_dir)
    p = keyed_parts(k).select("p_partkey", "p_brand", "clean_key", F.when(F.col("p_size") == 1, "Y").otherwise("N").alias("disabled"))
    l = table(spark, sf_dir, "lineitem")
    paid = l.where("l_returnflag = 'R' and l_partkey % 4 = 0").select(F.col("l_partkey").alias("p_partkey"))
    seen = l.where("l_partkey % 9 = 0").join(p.select(F.col("p_partkey").alias("l_partkey"), "clean_key"), "l_partkey").select("clean_key", F.concat(F.lit("file"), F.col("l_suppkey").cast("string")).alias("f"))
    return P.coverage_gap(p, paid, seen, "p_partkey", "clean_key", "f", "disabled")


def gap_grades(spark, sf_dir):
    return graded(spark, sf_dir).select("p_partkey", "paid", "sample_files", "grade")


def coverage_judged(spark, sf_dir):
    """Parts as service contents; lines returned at a discount as payments, dear lines as statement samples."""
    k = Keys(spark, sf_dir)
    p = keyed_parts(k).select("p_partkey", "p_brand", "clean_key", F.when(F.col("p_size") == 1, "Y").otherwise("N").alias("disabled"))
    l = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    no = F.col("l_orderkey") * 10**8 + F.col("l_linenumber") * 10**6 + F.col("l_suppkey")
    paid = l.where("l_returnflag = 'R' and l_discount >= 0.08 and l_tax <= 0.01").withColumn("no", no)
    seen = l.where("l_extendedprice > 99000").join(p, "p_partkey").select("clean_key", F.concat(F.lit("file"), F.col("l_suppkey").cast("string")).alias("f"))
    return P.coverage_judgement(p, paid, seen, "p_partkey", "clean_key", "f", "disabled", "no", ["l_linestatus", "l_suppkey"])


def coverage_judgement(spark, sf_dir):
    return coverage_judged(spark, sf_dir).drop("disabled", "clean_key")


def coverage_summary(spark, sf_dir):
    return P.coverage_summary(coverage_judged(spark, sf_dir), "p_brand")


def grade_pivot(spark, sf_dir):
    return P.grade_pivot(graded(spark, sf_dir), "p_brand")


def safe_candidates(spark, sf_dir):
    k = Keys(spark, sf_dir)
    master = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("content_id"))
    out = P.safe_candidates(linkage.explained(k), "billing | master", master, ["Brand#11"], "p_brand", guard="billing")
    return out.select(*ROW, "content_id", "excluded_because")


def reflection(spark, sf_dir):
    k = Keys(spark, sf_dir)
    p = keyed_parts(k)
    added = p.where("p_partkey % 5 = 0").select("p_brand", "clean_key", F.col("p_partkey").cast("string").alias("id"))
    return P.reflection(added, linkage.mapped(k).select("p_brand", "clean_key", "ref_selected_id"), ["p_brand", "clean_key"], "id", "ref_selected_id")


def schema_clusters(spark, sf_dir):
    return P.schema_clusters(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("signature", "sheets", "example", "rank")


_STATUS = """WITH jd AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS content, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'Y' ELSE 'N' END AS paid,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'Y' ELSE 'N' END AS disabled, (SELECT c_mktsegment FROM customer WHERE c_custkey = o_custkey) AS department FROM orders),
sx AS (SELECT *, CASE WHEN paid = 'N' AND max(paid) OVER (PARTITION BY content) = 'Y' THEN 'Y' ELSE 'N' END AS mixed_risk FROM jd),
sa AS (SELECT *, CASE WHEN disabled = 'Y' THEN 'BLOCK_DISABLED_MARKER' WHEN mixed_risk = 'Y' THEN 'HOLD_MIXED_CONTENT_RISK' WHEN paid = 'N' THEN 'HOLD_NO_PAYMENT_SETTLEMENT' ELSE 'OK_PAYMENT_SETTLEMENT_EXISTS' END AS status, '2026-05-09' AS as_of FROM sx),
gt AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(status, 'REVIEW_UNKNOWN_STATUS') AS gate_status FROM lineitem LEFT JOIN (SELECT * FROM sa WHERE department <> 'BUILDING') ON id = CAST(l_orderkey AS VARCHAR))
"""
_R = linkage.R
_N = "l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber"
_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in G.STATUSES)
_DIFF = """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || '!' ELSE c_name END AS c_name, CASE WHEN c_custkey % 11 = 0 THEN 'NEW' ELSE c_mktsegment END AS seg FROM customer WHERE c_custkey % 10 <> 2),
o AS (SELECT c_custkey, c_name, c_mktsegment AS seg FROM customer WHERE c_custkey % 10 <> 1),
d AS (SELECT CAST(coalesce(o.c_custkey, n.c_custkey) AS VARCHAR) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'deleted' WHEN o.c_name <> n.c_name OR o.seg <> n.seg THEN 'modified' END AS change,
 CASE WHEN o.c_custkey IS NULL OR n.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.c_name <> n.c_name THEN 'c_name' END, CASE WHEN o.seg <> n.seg THEN 'c_mktsegment' END) END AS changed_fields, o.c_name AS old_c_name, n.c_name AS new_c_name
 FROM o FULL JOIN n ON o.c_custkey = n.c_custkey)
"""
_KEY = linkage.REF_SQL + ", pk AS (SELECT *, clean_key || p_brand AS k FROM kp), sk AS (SELECT lineitem.*, k FROM lineitem JOIN pk ON l_partkey = p_partkey)\n"
_GRADE = linkage.REF_SQL + """, gs AS (SELECT p_partkey, p_brand, clean_key, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_partkey % 4 = 0) AS pd, p_size = 1 AS dis FROM kp),
fs AS (SELECT DISTINCT clean_key, 'file' || l_suppkey AS f FROM lineitem JOIN kp ON l_partkey = p_partkey WHERE l_partkey % 9 = 0),
fl AS (SELECT clean_key, string_agg(f, ' | ' ORDER BY f) AS files FROM (SELECT *, row_number() OVER (PARTITION BY clean_key ORDER BY f) AS n FROM fs) WHERE n <= 10 GROUP BY 1),
gg AS (SELECT p_partkey, p_brand, CASE WHEN pd THEN 'Y' ELSE 'N' END AS paid, coalesce(files, '') AS sample_files, CASE WHEN dis THEN 'C_DISABLED' WHEN pd THEN 'OK_PAID' WHEN files IS NOT NULL THEN 'A_SEEN_WITHOUT_PAYMENT' ELSE 'B_WITHOUT_PAYMENT' END AS grade FROM gs LEFT JOIN fl USING (clean_key))
"""

QUERIES = {
    "status_table": status_table, "gate_allowed": gate_allowed, "gate_blocked": gate_blocked, "gate_audit": gate_audit, "gate_summary": gate_summary, "status_by_department": status_by_department,
    "only_blocked_alerts": only_blocked_alerts, "blocked_title_hits": blocked_title_hits, "latest_lookup": latest_lookup, "conflict_counts": conflict_counts, "profile": profile, "value_counts": value_counts,
    "snapshot_diff": snapshot_diff, "change_summary": change_summary, "change_feed": change_feed, "compare_ids": compare_ids, "work_order": work_order, "combined_report": combined_report,
    "batch_summary": batch_summary, "reconcile_amounts": reconcile_amounts, "gap_grades": gap_grades, "coverage_judgement": coverage_judgement, "coverage_summary": coverage_summary, "grade_pivot": grade_pivot, "safe_candidates": safe_candidates, "reflection": reflection, "schema_clusters": schema_clusters,
}

_JUDGED = f"""WITH {linkage.PART_SQL} pd AS (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.08 AND l_tax <= 0.01),
pf AS (SELECT l_partkey, arg_min(l_linestatus, no) AS ls, arg_min(l_suppkey, no) AS sk FROM (SELECT *, l_orderkey * 100000000 + l_linenumber * 1000000 + l_suppkey AS no FROM pd) GROUP BY 1),
sm AS (SELECT DISTINCT clean_key, 'file' || l_suppkey AS f FROM lineitem JOIN kp ON l_partkey = p_partkey WHERE l_extendedprice > 99000 AND clean_key <> ''),
sl AS (SELECT clean_key, string_agg(f, ' | ' ORDER BY f) AS fs FROM (SELECT *, row_number() OVER (PARTITION BY clean_key ORDER BY f) AS n FROM sm) WHERE n <= 10 GROUP BY 1),
jg AS (SELECT p_partkey, p_brand, CASE WHEN pf.l_partkey IS NULL THEN 'N' ELSE 'Y' END AS paid, coalesce(fs, '') AS sample_files, ls, sk,
 CASE WHEN p_size = 1 THEN 'C_DISABLED' WHEN pf.l_partkey IS NOT NULL THEN 'OK_PAID' WHEN fs IS NOT NULL THEN 'A_SEEN_WITHOUT_PAYMENT' ELSE 'B_WITHOUT_PAYMENT' END AS grade FROM kp LEFT JOIN pf ON l_partkey = p_partkey LEFT JOIN sl USING (clean_key))
"""
_ACTION = "CASE grade " + " ".join(f"WHEN '{g}' THEN '{a}'" for g, a in P.GRADE_ACTIONS.items()) + " END"
ORACLE_SQL = {
    "status_table": _STATUS + "SELECT id, content, paid, disabled, department, mixed_risk, status, as_of FROM sa",
    "gate_allowed": _STATUS + f"SELECT {_R}, gate_status FROM gt WHERE gate_status LIKE 'OK\\_%' ESCAPE '\\'",
    "gate_blocked": _STATUS + f"SELECT {_R}, gate_status FROM gt WHERE gate_status NOT LIKE 'OK\\_%' ESCAPE '\\'",
    "gate_audit": _STATUS + "SELECT gate_status, count(*) AS n FROM gt GROUP BY 1",
    "gate_summary": _STATUS + f"SELECT count(*) AS \"rows\", count(DISTINCT id) AS ids, count(*) FILTER (paid = 'N') AS unpaid, {_COUNTS}, count(*) FILTER (mixed_risk = 'Y') AS mixed_rows, count(DISTINCT content) FILTER (mixed_risk = 'Y') AS mixed_contents FROM sa",
    "status_by_department": _STATUS + f"SELECT d AS department, {_COUNTS} FROM (VALUES ('AUTOMOBILE'), ('BUILDING'), ('FURNITURE'), ('MACHINERY'), ('NONE')) v(d) LEFT JOIN sa ON department = d GROUP BY 1",
    "only_blocked_alerts": _KEY + f"SELECT {_R}, k, (SELECT count(*) FROM pk WHERE pk.k = sk.k AND p_size <= 20) AS blocked_rows FROM sk WHERE EXISTS (SELECT 1 FROM pk WHERE pk.k = sk.k AND p_size <= 20) AND NOT EXISTS (SELECT 1 FROM pk WHERE pk.k = sk.k AND p_size > 20)",
    "blocked_title_hits": _KEY + f"SELECT {_R}, sk.k, pk.p_partkey AS blocked_id FROM sk JOIN pk ON pk.k = sk.k AND p_size <= 5",
    "latest_lookup": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, event_id) AS n FROM events) WHERE n = 1",
    "conflict_counts": "SELECT count(*) FILTER (r > 1) AS several_rows, count(*) FILTER (s > 1) AS several_o_orderstatus, count(*) FILTER (p > 1) AS several_o_orderpriority FROM (SELECT count(*) AS r, count(DISTINCT o_orderstatus) AS s, count(DISTINCT o_orderpriority) AS p FROM orders GROUP BY o_custkey)",
    "profile": "SELECT unnest(['rows', 'columns', 'o_custkey filled', 'o_custkey distinct', 'o_orderstatus filled', 'o_orderstatus distinct', 'first date', 'last date']) AS item, unnest([CAST(count(*) AS VARCHAR), '7', CAST(count(o_custkey) AS VARCHAR), CAST(count(DISTINCT o_custkey) AS VARCHAR), CAST(count(o_orderstatus) AS VARCHAR), CAST(count(DISTINCT o_orderstatus) AS VARCHAR), strftime(min(o_orderdate), '%Y-%m-%d'), strftime(max(o_orderdate), '%Y-%m-%d')]) AS value FROM orders",
    "value_counts": "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1",
    "snapshot_diff": _DIFF + "SELECT * FROM d WHERE change IS NOT NULL",
    "change_summary": _DIFF + "SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'modified') AS modified FROM d",
    "change_feed": _DIFF + "SELECT c_custkey, change FROM (SELECT c_custkey, change FROM d WHERE change IS NOT NULL AND CAST(c_custkey AS INT) % 5 = 3 ORDER BY CASE change WHEN 'modified' THEN 0 WHEN 'added' THEN 1 ELSE 2 END, c_custkey LIMIT 50)",
    "compare_ids": "WITH a AS (SELECT DISTINCT o_custkey AS i FROM orders), b AS (SELECT DISTINCT c_custkey AS i FROM customer) SELECT (SELECT count(*) FROM a JOIN b USING (i)) AS overlap, (SELECT count(*) FROM a ANTI JOIN b USING (i)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (i)) AS only_b, NOT EXISTS (SELECT 1 FROM a ANTI JOIN b USING (i)) AND NOT EXISTS (SELECT 1 FROM b ANTI JOIN a USING (i)) AS equal",
    "work_order": linkage.REF_SQL + f", wr AS (SELECT *, {_N} AS no FROM xp WHERE xp.review_reason <> ''), wf AS (SELECT *, CASE WHEN split_reason <> '' THEN concat_ws(' | ', review_reason, split_reason) ELSE review_reason END AS rr FROM wr), wl AS (SELECT p_brand, clean_key, detail_reason, string_agg(CAST(l_orderkey AS VARCHAR), ' | ' ORDER BY f) AS l FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, clean_key, detail_reason ORDER BY f) AS n FROM (SELECT p_brand, clean_key, detail_reason, l_orderkey, min(no) AS f FROM wf GROUP BY ALL)) WHERE n <= 30 GROUP BY ALL) SELECT p_brand, clean_key, detail_reason, min(no) AS first_no, count(*) AS group_size, arg_min(rr, no) AS review_reason, md5(any_value(l)) AS orders_md5 FROM wf JOIN wl USING (p_brand, clean_key, detail_reason) GROUP BY ALL",
    "combined_report": linkage.REF_SQL + f"SELECT {_R}, ref_status, detail_reason, '' AS note FROM xp",
    "batch_summary": linkage.REF_SQL + "SELECT p_brand, count(*) AS \"rows\", count(*) FILTER (ref_status = 'matched') AS matched, count(*) FILTER (ref_status = 'no_match') AS no_match, count(*) FILTER (review_reason <> '') AS to_review FROM mr GROUP BY 1",
    "reconcile_amounts": "WITH a AS (SELECT l_suppkey, count(*) AS r, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS r, round(sum(l_quantity + CASE WHEN l_suppkey % 5 = 2 THEN 1 ELSE 0 END), 2) AS q FROM lineitem WHERE l_suppkey % 5 <> 1 GROUP BY 1), j AS (SELECT CAST(s_suppkey AS VARCHAR) AS s, coalesce(a.r, 0) AS a_rows, coalesce(a.q, 0) AS a_l_quantity, coalesce(b.r, 0) AS b_rows, coalesce(b.q, 0) AS b_l_quantity FROM supplier LEFT JOIN a ON a.l_suppkey = s_suppkey LEFT JOIN b ON b.l_suppkey = s_suppkey) SELECT *, round(a_l_quantity - b_l_quantity, 2) AS delta_l_quantity, CASE WHEN a_rows = 0 AND b_rows = 0 THEN 'absent' WHEN a_rows = 0 THEN 'only_b' WHEN b_rows = 0 THEN 'only_a' WHEN abs(a_l_quantity - b_l_quantity) < 1 THEN CASE WHEN a_rows = b_rows THEN 'equal' ELSE 'amounts_equal' END ELSE 'differs' END AS status FROM j",
    "coverage_judgement": _JUDGED + "SELECT p_partkey, p_brand, paid, sample_files, grade, " + _ACTION + " AS action, CASE WHEN sample_files <> '' THEN 'Y' ELSE 'N' END AS in_samples, coalesce(ls, '') AS paid_l_linestatus, coalesce(CAST(sk AS VARCHAR), '') AS paid_l_suppkey FROM jg",
    "coverage_summary": _JUDGED + "SELECT p_brand, false AS total, grade, count(*) AS n FROM jg GROUP BY 1, 3 UNION ALL SELECT '', true, grade, count(*) FROM jg GROUP BY 3",
    "gap_grades": _GRADE + "SELECT p_partkey, paid, sample_files, grade FROM gg",
    "grade_pivot": _GRADE + "SELECT p_brand, count(*) FILTER (grade = 'A_SEEN_WITHOUT_PAYMENT') AS a_seen_without_payment, count(*) FILTER (grade = 'B_WITHOUT_PAYMENT') AS b_without_payment, count(*) FILTER (grade = 'C_DISABLED') AS c_disabled, count(*) FILTER (grade = 'OK_PAID') AS ok_paid FROM gg GROUP BY 1",
    "safe_candidates": linkage.REF_SQL + f", bx AS (SELECT *, string_split(b_ids, ' | ') AS bl FROM xp WHERE detail_reason = 'billing | master') SELECT {_R}, CASE WHEN len(bl) = 1 THEN bl[1] ELSE '' END AS content_id, CASE WHEN p_brand = 'Brand#11' THEN 'special channel' WHEN len(bl) <> 1 THEN 'not one content' WHEN NOT EXISTS (SELECT 1 FROM part WHERE CAST(p_partkey AS VARCHAR) = bl[1] AND p_size % 2 = 0) THEN 'not in master' ELSE '' END AS excluded_because FROM bx",
    "reflection": linkage.REF_SQL + "SELECT kp.p_brand, kp.clean_key, CAST(p_partkey AS VARCHAR) AS id, (SELECT count(*) FROM mp WHERE mp.p_brand = kp.p_brand AND mp.clean_key = kp.clean_key) AS rerun_rows, (SELECT count(DISTINCT nullif(ref_selected_id, '')) FROM mp WHERE mp.p_brand = kp.p_brand AND mp.clean_key = kp.clean_key) AS rerun_ids, CASE WHEN EXISTS (SELECT 1 FROM mp WHERE mp.p_brand = kp.p_brand AND mp.clean_key = kp.clean_key AND ref_selected_id = CAST(p_partkey AS VARCHAR)) THEN 'Y' ELSE 'N' END AS reflected FROM kp WHERE p_partkey % 5 = 0",
    "schema_clusters": "WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2), s AS (SELECT user_id, string_agg(event_type, ' > ' ORDER BY e) AS signature FROM f GROUP BY 1), g AS (SELECT signature, count(*) AS sheets, min(user_id) AS example FROM s GROUP BY 1) SELECT *, row_number() OVER (ORDER BY sheets DESC, signature) AS rank FROM g",
}
