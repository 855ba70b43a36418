"""Audit queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import audit as A
from quillmatch.plans.linkage import ROW, Keys, keyed_parts, table


def catalog(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.select(F.col("n_name").alias("channel"), F.col("s_suppkey").alias("channel_id"), F.col("s_name").alias("partner"))


def rules(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_regionkey").alias("platform"), F.col("n_name").alias("channel"))


def build_targets(spark, sf_dir):
    return A.build_targets(rules(spark, sf_dir), catalog(spark, sf_dir))[0].select("platform", "channel", "channel_id", "partner")


def missing_targets(spark, sf_dir):
    return A.build_targets(rules(spark, sf_dir), catalog(spark, sf_dir).where("channel_id % 4 = 0"))[1].select("platform", "channel")


def platform_filter(spark, sf_dir):
    return A.platform_filter(table(spark, sf_dir, "part"), "p_brand", ["Brand#11"], ["#2", "#3"], ["5"]).select("p_partkey", "p_brand")


def channel_filter_audit(spark, sf_dir):
    return A.channel_filter_audit(table(spark, sf_dir, "part"), "p_brand", "Brand#12")


def file_status(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(".xlsx")).alias("file"), F.col("p_brand").alias("platform"))
    return A.file_status(files, "file", ["^blue", "gizmo"], ["Brand#12"], ["Brand#13"]).select("p_partkey", "file_status")


def health(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("success").alias("status"), F.col("o_orderdate").alias("finished"), F.col("o_custkey").alias("rows"))
    tables = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct().withColumn("rows", F.lit(5).cast("long"))
    return A.health(runs, tables, F.to_timestamp(F.lit("2030-01-01 00:00:00")))


def self_check(spark, sf_dir):
    k = Keys(spark, sf_dir)
    p = keyed_parts(k).select(F.col("p_partkey").alias("l_partkey"), "title", F.when(F.col("p_partkey") % 97 == 0, F.lit("")).otherwise(F.col("clean_key")).alias("clean_key"))
    stmt = table(spark, sf_dir, "lineitem").select(*ROW).join(p, "l_partkey")
    return A.self_check(stmt, "clean_key", "title", "l_orderkey")


def platform_rollup(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("size"), F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("error"))
    dim = files.select("user_id").union(spark.range(1).select((F.col("id") - 1).alias("user_id")))
    return A.platform_rollup(files, dim, "user_id", ["size"], "error")


QUERIES = {"build_targets": build_targets, "missing_targets": missing_targets, "platform_filter": platform_filter, "channel_filter_audit": channel_filter_audit, "file_status": file_status, "health": health, "self_check": self_check, "platform_rollup": platform_rollup}

ORACLE_SQL = {
    "build_targets": "SELECT n_regionkey AS platform, n_name AS channel, s_suppkey AS channel_id, s_name AS partner FROM nation JOIN supplier ON s_nationkey = n_nationkey",
    "missing_targets": "SELECT n_regionkey AS platform, n_name AS channel FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 4 = 0)",
    "platform_filter": "SELECT p_partkey, p_brand FROM part WHERE (p_brand = 'Brand#11' OR contains(p_brand, '#2') OR contains(p_brand, '#3')) AND NOT contains(p_brand, '5')",
    "channel_filter_audit": "SELECT count(*) AS before, count(*) FILTER (p_brand = 'Brand#12') AS after, 'filtered' AS reason FROM part",
    "file_status": "SELECT p_partkey, CASE WHEN p_brand = 'Brand#13' THEN 'blocked_source' WHEN starts_with(p_name, 'blue') OR contains(p_name, 'gizmo') THEN 'excluded_by_rule' WHEN p_brand = 'Brand#12' THEN 'review_gate_not_default' ELSE 'include' END AS file_status FROM part",
    "health": "WITH g AS (SELECT o_orderpriority AS name, max(o_orderdate) AS f, arg_max(o_custkey, (o_orderdate, o_orderkey)) AS l FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1), z AS (SELECT o_orderpriority AS name, arg_max(o_orderkey, o_orderkey) % 3 = 0 AS bad FROM orders GROUP BY 1) SELECT name, CAST(5 AS BIGINT) AS \"rows\", CAST(floor((epoch(TIMESTAMP '2030-01-01') - epoch(f)) / 3600) AS BIGINT) AS hours, 5 - l AS drift, concat_ws(' | ', 'stale', CASE WHEN l <> 5 THEN 'row count differs' END, CASE WHEN bad THEN 'last run failed' END) AS warnings FROM g JOIN z USING (name)",
    "self_check": "SELECT count(*) AS \"rows\", count(*) FILTER (l_partkey % 97 <> 0) AS matched, count(*) FILTER (l_partkey % 97 = 0) AS blank FROM lineitem",
    "platform_rollup": "WITH f AS (SELECT user_id, count(*) AS files, sum(event_id) AS size FROM events GROUP BY 1), e AS (SELECT user_id, string_agg(event_type, ' | ' ORDER BY event_type) AS errors FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS n FROM (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 5 = 0)) WHERE n <= 3 GROUP BY 1) SELECT user_id, files, CAST(size AS BIGINT) AS size, coalesce(errors, '') AS errors, CASE WHEN errors IS NULL THEN 'ok' ELSE 'errors' END AS status FROM f LEFT JOIN e USING (user_id) UNION ALL SELECT -1, 0, 0, '', 'no files'",
}
