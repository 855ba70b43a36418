"""Queries about guard tables, explanations by source and backfills, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import guards as G
from quillmatch.operators import linkage as L
from quillmatch.operators import reports as P
from quillmatch.plans import linkage
from quillmatch.plans.linkage import ROW, Keys, keyed_parts, table

KEYS = ["p_brand", "clean_key"]


def raw_guard(spark, sf_dir):
    """Events as rows of an interface: several a user, some without an id."""
    user = F.when(F.col("event_id") % 10 == 0, F.lit("")).otherwise(F.concat(F.col("user_id").cast("string"), F.lit(".0")))
    return table(spark, sf_dir, "events").select("event_id", user.alias("schnCtnsId"), F.concat(F.lit(" [BL] "), "event_type", F.lit(" 3화")).alias("ctnsNm"), F.col("event_type").alias("schnNm"))


def guard_normalize(spark, sf_dir):
    return G.normalize_guard(raw_guard(spark, sf_dir), G.MISSING, ["event_id"]).select("channel_content_id", "title", "clean_key", "channel", "content_id", "reason")


def explain_sources(spark, sf_dir):
    k = Keys(spark, sf_dir)
    rows = linkage.explained(k, other=True)
    return rows.select(*ROW, "detail_reason", "detail_action", "split_reason", "missing_hits", "other_channel_hits", F.md5("detail_evidence").alias("evidence_md5"))


def guard_summary(spark, sf_dir):
    k = Keys(spark, sf_dir)
    rows = linkage.explained(k, other=True)
    return G.guard_summary(L.mapping_summary(linkage.mapped(k)), rows)


def input_validation(spark, sf_dir):
    k = Keys(spark, sf_dir)
    p = keyed_parts(k)
    sides = {"reference": (p.where("p_size <= 25"), "title", "id", k.reference), "statement": (linkage.statements(k), "title", None, None), "master": (p.where("p_size between 10 and 40"), "title", "id", linkage.master(k))}
    return G.input_validation(sides, listed={"master": ["p_type"]})


def refresh_summary(spark, sf_dir):
    raw = raw_guard(spark, sf_dir)
    lookup = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("channel_content_id"))
    return G.refresh_summary({"missing": (raw, G.normalize_guard(raw, G.MISSING, ["event_id"]), ["channel", "department"])}, lookup, "channel_content_id")


def verify_ids(spark, sf_dir):
    c = F.col("c_custkey")
    added = table(spark, sf_dir, "customer").select(F.when(c % 13 == 0, F.lit("")).otherwise(F.concat(c.cast("string"), F.lit(".0"))).alias("id"), "c_name")
    lookup = table(spark, sf_dir, "orders").withColumn("id", F.col("o_custkey").cast("string"))
    return G.verify_ids(added, lookup, "id", ["o_orderstatus", "o_orderpriority"], ["o_orderkey"])


def candidate_counts(spark, sf_dir):
    k = Keys(spark, sf_dir)
    master = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").cast("string").alias("content_id"))
    return G.candidate_counts(P.safe_candidates(linkage.explained(k), "billing | master", master, ["Brand#11"], "p_brand", guard="billing"), "p_brand")


def rerun_affected(spark, sf_dir):
    k = Keys(spark, sf_dir)
    stmt = linkage.statements(k)
    p = keyed_parts(k).withColumn("id", F.col("p_partkey").cast("string"))
    added = p.where("p_size = 26 and p_partkey % 11 = 0")
    more = L.candidate_index(p.where("p_size <= 25").unionByName(added), KEYS, "id", "title", "p_partkey")
    before = L.map_statements(stmt, k.reference, KEYS)
    return G.rerun_affected(before, stmt, added, "p_brand", lambda s: L.map_statements(s, more, KEYS), ROW)


QUERIES = {
    "guard_normalize": guard_normalize, "explain_sources": explain_sources, "guard_summary": guard_summary, "input_validation": input_validation, "refresh_summary": refresh_summary,
    "verify_ids": verify_ids, "candidate_counts": candidate_counts, "rerun_affected": rerun_affected,
}

_RAW = f"""WITH raw AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS id, event_type, '[BL] ' || event_type || ' 3화' AS title FROM events),
mis AS (SELECT id, title, {linkage._clean("title")} AS clean_key, event_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY event_id) AS n FROM raw WHERE id <> '') WHERE n = 1)
"""
_q = lambda v: v.replace("'", "''")
_HIT = lambda cases, sep: f"concat_ws('{sep}', " + ", ".join(f"CASE WHEN {c} THEN '{_q(v)}' END" for c, v in cases) + ")"
_CASES = [("m_ids IS NOT NULL", "missing"), ("s_ids IS NOT NULL", "service"), ("b_ids IS NOT NULL", "billing"), ("brands IS NOT NULL", "other_channel"), ("e_ids IS NOT NULL", "master")]
_SOURCES = linkage.REF_SQL + f""", oc AS (SELECT clean_key, p_brand, min(p_partkey) AS f FROM kp WHERE p_size <= 25 GROUP BY 1, 2),
oi AS (SELECT clean_key, max(total) AS total, string_agg(CAST(p_partkey AS VARCHAR), ' | ' ORDER BY p_partkey) AS o_ids FROM (SELECT *, row_number() OVER (PARTITION BY clean_key ORDER BY p_partkey) AS n, count(*) OVER (PARTITION BY clean_key) AS total FROM kp WHERE p_size <= 25) WHERE n <= 30 GROUP BY 1),
oo AS (SELECT b.p_brand, oc.clean_key, string_agg(oc.p_brand, ' | ' ORDER BY f) AS brands FROM (SELECT DISTINCT p_brand FROM kp) b JOIN oc ON oc.p_brand <> b.p_brand GROUP BY 1, 2),
mh AS (SELECT p_brand, clean_key, count(*) AS hits FROM kp WHERE p_size BETWEEN 26 AND 32 GROUP BY 1, 2),
sx AS (SELECT ex.*, brands, o_ids, total, hits FROM ex LEFT JOIN oo ON oo.p_brand = ex.p_brand AND oo.clean_key = ex.clean_key LEFT JOIN oi ON oi.clean_key = ex.clean_key LEFT JOIN mh ON mh.p_brand = ex.p_brand AND mh.clean_key = ex.clean_key),
sd AS (SELECT *, CASE ref_status WHEN 'matched' THEN '' WHEN 'blank_key' THEN 'no key' ELSE coalesce(nullif({_HIT(_CASES, " | ")}, ''), 'no candidate') END AS reason,
 CASE ref_status WHEN 'matched' THEN '' WHEN 'blank_key' THEN '{_q(L.ACTIONS["blank_key"])}' ELSE coalesce(nullif({_HIT([(c, L.ACTIONS[v]) for c, v in _CASES], " | ")}, ''), '{_q(L.ACTIONS["none"])}') END AS act,
 CASE WHEN ref_status = 'no_match' THEN {_HIT([_CASES[0], _CASES[2]], " | ")} ELSE '' END AS split, ref_status = 'no_match' AS none FROM sx)
"""

ORACLE_SQL = {
    "guard_normalize": _RAW + "SELECT id AS channel_content_id, title, clean_key, event_type AS channel, '' AS content_id, 'missing' AS reason FROM mis",
    "explain_sources": _SOURCES + f"""SELECT {linkage.R}, reason AS detail_reason, act AS detail_action, split AS split_reason, CASE WHEN none THEN coalesce(hits, 0) ELSE 0 END AS missing_hits, CASE WHEN none AND brands IS NOT NULL THEN total ELSE 0 END AS other_channel_hits,
 md5(CASE WHEN NOT none THEN '' ELSE coalesce(nullif(concat_ws(' || ', 'missing: id=' || m_ids || ', title=' || m_t, 'service: id=' || s_ids || ', title=' || s_t, 'billing: id=' || b_ids, 'other_channel: p_brand=' || brands || ', id=' || o_ids, 'master: id=' || e_ids), ''), 'key=' || clean_key) END) AS evidence_md5 FROM sd""",
    "guard_summary": _SOURCES + """SELECT 'rows' AS item, count(*) AS value FROM mr UNION ALL SELECT 'review', count(*) FROM mr WHERE review_reason <> '' UNION ALL SELECT 'ref ' || s, (SELECT count(*) FROM mr WHERE ref_status = s) FROM (VALUES ('matched'), ('ambiguous'), ('no_match'), ('blank_key')) t(s)
 UNION ALL SELECT 'master ' || s, (SELECT count(*) FROM mr WHERE master_status = s) FROM (VALUES ('matched'), ('ambiguous'), ('no_match'), ('blank_key'), ('skipped')) t(s)
 UNION ALL SELECT 'missing candidates', count(*) FROM sd WHERE none AND m_ids IS NOT NULL UNION ALL SELECT 'billing candidates', count(*) FROM sd WHERE none AND b_ids IS NOT NULL UNION ALL SELECT 'service candidates', count(*) FROM sd WHERE none AND s_ids IS NOT NULL
 UNION ALL SELECT 'no match: ' || reason, count(*) FROM sd WHERE reason <> '' GROUP BY reason""",
    "input_validation": linkage.REF_SQL + """SELECT 'reference rows' AS item, CAST(count(*) AS VARCHAR) AS value FROM kp WHERE p_size <= 25 UNION ALL SELECT 'reference title column', 'title' UNION ALL SELECT 'reference id column', 'id' UNION ALL SELECT 'reference blank keys', CAST(count(*) FILTER (clean_key = '') AS VARCHAR) FROM kp WHERE p_size <= 25
 UNION ALL SELECT 'reference keys of several ids', CAST(count(*) FILTER (id_count > 1) AS VARCHAR) FROM ref UNION ALL SELECT 'statement rows', CAST(count(*) AS VARCHAR) FROM st UNION ALL SELECT 'statement title column', 'title' UNION ALL SELECT 'statement blank keys', CAST(count(*) FILTER (clean_key = '') AS VARCHAR) FROM st
 UNION ALL SELECT 'master rows', CAST(count(*) AS VARCHAR) FROM kp WHERE p_size BETWEEN 10 AND 40 UNION ALL SELECT 'master title column', 'title' UNION ALL SELECT 'master id column', 'id' UNION ALL SELECT 'master blank keys', CAST(count(*) FILTER (clean_key = '') AS VARCHAR) FROM kp WHERE p_size BETWEEN 10 AND 40
 UNION ALL SELECT 'master keys of several ids', CAST(count(*) FILTER (id_count > 1) AS VARCHAR) FROM ms UNION ALL SELECT 'master p_type', (SELECT string_agg(p_type, ' | ' ORDER BY p_type) FROM (SELECT DISTINCT p_type FROM kp WHERE p_size BETWEEN 10 AND 40 ORDER BY 1 LIMIT 10))""",
    "refresh_summary": _RAW + """SELECT 'missing' AS part, 'raw rows' AS item, count(*) AS n FROM raw UNION ALL SELECT 'missing', 'rows', count(*) FROM mis UNION ALL SELECT 'missing', 'channel: ' || event_type, count(*) FROM mis GROUP BY event_type UNION ALL SELECT 'missing', 'department: (blank)', count(*) FROM mis
 UNION ALL SELECT 'missing', 'in lookup', count(*) FROM mis WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey % 2 = 0 AND CAST(c_custkey AS VARCHAR) = id)""",
    "verify_ids": "WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1) SELECT c_name, CAST(c_custkey AS VARCHAR) AS id, CASE WHEN o_custkey IS NULL THEN 'N' ELSE 'Y' END AS found, coalesce(o_orderstatus, '') AS found_o_orderstatus, coalesce(o_orderpriority, '') AS found_o_orderpriority FROM customer LEFT JOIN f ON o_custkey = c_custkey WHERE c_custkey % 13 <> 0",
    "candidate_counts": linkage.REF_SQL + ", bx AS (SELECT *, string_split(b_ids, ' | ') AS bl FROM xp WHERE detail_reason = 'billing | master') SELECT p_brand, CASE WHEN p_brand = 'Brand#11' THEN 'special channel' WHEN len(bl) <> 1 THEN 'not one content' WHEN NOT EXISTS (SELECT 1 FROM part WHERE CAST(p_partkey AS VARCHAR) = bl[1] AND p_size % 2 = 0) THEN 'not in master' ELSE 'safe' END AS excluded_because, count(*) AS n FROM bx GROUP BY ALL",
    "rerun_affected": linkage.REF_SQL + """, ad AS (SELECT p_brand, clean_key FROM kp WHERE p_size = 26 AND p_partkey % 11 = 0),
 rr AS (SELECT mp.p_brand, ref_status = 'matched' AS was, mp.clean_key <> '' AND (ref_status = 'matched' OR EXISTS (SELECT 1 FROM ad WHERE ad.p_brand = mp.p_brand AND ad.clean_key = mp.clean_key)) AS now FROM mp WHERE EXISTS (SELECT 1 FROM ad WHERE ad.p_brand = mp.p_brand))
SELECT p_brand, count(*) AS "rows", count(*) FILTER (was) AS matched_before, count(*) FILTER (now) AS matched_after, count(*) FILTER (now AND NOT was) AS newly_matched, count(*) FILTER (was AND NOT now) AS lost FROM rr GROUP BY 1""",
}
