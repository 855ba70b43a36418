"""Queries about runs that write: references as index tables, mapping runs, versions, reports of touched channels, ordered parts; and profiles in two scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmatch.operators import guards as G
from quillmatch.operators import linkage as L
from quillmatch.operators import ranks, tops
from quillmatch.operators import refresh as R
from quillmatch.operators import reports as P
from quillmatch.plans import imports, linkage
from quillmatch.plans.linkage import Keys, keyed_parts, table
from quillmatch.sources import io, reference, scratch, versions

KEYS = ["p_brand", "clean_key"]


def build_reference(spark, sf_dir):
    """Parts as payable content, the largest size of each type disabled, as an index table; read back with how many statements meet each key."""
    k = Keys(spark, sf_dir)
    p = linkage.titled(k.table("part")).withColumn("title", F.when(F.col("p_size") == 50, F.concat("title", F.lit(" (사용금지)"))).otherwise(F.col("title")))
    index = reference.build_reference(p.withColumn("id", F.col("p_partkey").cast("string")), KEYS, "id", "title", "p_partkey", extras=["p_type"])
    held = reference.index_table(index, KEYS)
    seen = linkage.statements(k).groupBy(*KEYS).agg(F.count("*").alias("lines"))
    return held.join(seen, KEYS, "left").select(*KEYS, "status", "id_count", "selected_id", "list_p_type", F.coalesce("lines", F.lit(0)).alias("lines"))


def mapping_run(spark, sf_dir):
    """The summary of a run whose five tables are written; its review table's rows as one more item."""
    k = Keys(spark, sf_dir)
    path = scratch.folder(spark, "runs")
    dup = L.duplicates(k.reference, linkage.statements(k), KEYS)
    validation = G.input_validation({"statement": (linkage.statements(k), "title", None, None)})
    summary = io.write_mapping_run(linkage.mapped(k, clustered=True), dup, validation, path)
    review = spark.read.parquet(f"{path}/review").agg(F.lit("rows written to review").alias("item"), F.count("*").alias("value"))
    return summary.unionByName(review)


def value_tops(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand"), "l_partkey")
    rows = lines.withColumn("mode", F.when(F.col("l_returnflag") == "A", " ").otherwise(F.col("l_returnflag")))
    return tops.top_values(rows, ["mode", "l_linestatus", "p_name", "p_brand", "l_suppkey", "l_orderkey"], 20)


def global_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return ranks.global_rank(o, [F.desc("o_orderstatus"), F.col("o_totalprice").desc(), F.col("o_orderkey")], "place")


def ordered_parts(spark, sf_dir):
    """Orders by status descending, then by number, as files of 4,000 rows; read back."""
    path = scratch.folder(spark, "parts")
    ranks.write_ordered(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_orderpriority"), [F.desc("o_orderstatus"), F.col("o_orderkey")], path, 4000)
    return ranks.read_ordered(spark, path).select("file_no", "row_no", "o_orderstatus", F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderpriority")


def rerun_reports(spark, sf_dir):
    """The summary of each brand and size is written for all brands; then parts are added to the reference and only the touched brands' reports
    written again. All reports as they are at the end."""
    k = Keys(spark, sf_dir)
    p = keyed_parts(k).withColumn("id", F.col("p_partkey").cast("string"))
    added = p.where("p_size = 26 and p_retailprice > 950")
    more = L.candidate_index(p.where("p_size <= 25").unionByName(added), KEYS, "id", "title", "p_partkey")

    def report(stmt, index):
        return P.batch_summary(L.map_statements(stmt, index, KEYS), "clean_key", by=["p_brand"])

    path = scratch.folder(spark, "reports")
    stmt = linkage.statements(k)
    io.write_reports(report(stmt, k.reference), "p_brand", path)
    touched = added.select("p_brand").distinct()
    lineage = added.groupBy("p_brand").agg(F.count("*").alias("additions"), F.min("p_partkey").alias("first"))
    io.rewrite_reports(report(stmt.join(touched, "p_brand", "left_semi"), more), touched, "p_brand", path, lineage)
    return spark.read.parquet(path).join(spark.read.parquet(f"{path}-lineage"), "p_brand", "left").na.fill(0, ["additions"]).drop("first")


def refresh_logged(spark, sf_dir):
    """A lookup refreshed twice, each time as a new version; the runs as logged, with the rows of the version each made."""
    rows, path = imports.lookups(spark, sf_dir), scratch.folder(spark, "lookups")
    made = {}
    for run, part in (("first", "o_orderkey % 10 <> 1"), ("second", "o_orderkey % 10 <> 2")):
        v = R.replace_lookup(rows.where(part), f"{path}/table", f"{path}/log", run, "id", "day", ["o_orderkey"], "title", ["master_id"])
        made[run] = versions.read_table(spark, f"{path}/table", v).agg(F.lit(run).alias("run_id"), F.count("*").alias("rows"), F.max("o_orderkey").alias("greatest"))
    return spark.read.parquet(f"{path}/log/runs").join(made["first"].unionAll(made["second"]), "run_id").select("run_id", "status", "version", "added", "deleted", "modified", "rows", "greatest")


QUERIES = {
    "build_reference": build_reference, "mapping_run": mapping_run, "value_tops": value_tops, "global_order": global_order, "ordered_parts": ordered_parts, "rerun_reports": rerun_reports,
    "refresh_logged": refresh_logged,
}

_TOP = ["CASE WHEN l_returnflag = 'A' THEN '(blank)' ELSE l_returnflag END", "l_linestatus", "p_name", "p_brand", "l_suppkey", "l_orderkey"]
ORACLE_SQL = {
    "build_reference": f"WITH {linkage.PART_SQL}" + """ok AS (SELECT *, row_number() OVER (PARTITION BY p_brand, clean_key ORDER BY p_partkey) AS n FROM kp WHERE p_size <> 50 AND clean_key <> ''),
ty AS (SELECT p_brand, clean_key, string_agg(p_type, ' | ' ORDER BY f) AS types FROM (SELECT p_brand, clean_key, p_type, min(p_partkey) AS f FROM ok GROUP BY ALL) GROUP BY 1, 2),
ln AS (SELECT p_brand, CASE WHEN p_partkey % 97 = 0 THEN '' ELSE clean_key END AS clean_key, count(*) AS lines FROM lineitem JOIN kp ON l_partkey = p_partkey GROUP BY ALL)
SELECT ok.p_brand, ok.clean_key, 'matched' AS status, count(*) AS id_count, CAST(min(p_partkey) AS VARCHAR) AS selected_id, any_value(types) AS list_p_type, coalesce(any_value(lines), 0) AS lines
FROM ok JOIN ty USING (p_brand, clean_key) LEFT JOIN ln USING (p_brand, clean_key) GROUP BY 1, 2""",
    "mapping_run": linkage.ORACLE_SQL["map_summary"] + " UNION ALL SELECT 'rows written to review', count(*) FROM mr WHERE review_reason <> ''",
    "value_tops": "WITH x AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey), v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS c, CAST({e} AS VARCHAR) AS value, count(*) AS n FROM x GROUP BY 2" for n, e in zip(["mode", *_TOP[1:]], _TOP, strict=True)) + ") SELECT c AS \"column\", value, n, row_number() OVER (PARTITION BY c ORDER BY n DESC, value) AS place FROM v QUALIFY place <= 20",
    "global_order": "SELECT o_orderkey, o_orderstatus, o_totalprice, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice DESC, o_orderkey) AS place FROM orders",
    "ordered_parts": "SELECT (n - 1) // 4000 + 1 AS file_no, (n - 1) % 4000 + 1 AS row_no, o_orderstatus, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY o_orderstatus DESC, o_orderkey) AS n FROM orders)",
    "rerun_reports": linkage.REF_SQL + """, ad AS (SELECT p_brand, clean_key FROM kp WHERE p_size = 26 AND p_retailprice > 950), li AS (SELECT p_brand, count(*) AS additions FROM ad GROUP BY 1),
 rr AS (SELECT mp.p_brand, mp.clean_key, mp.clean_key <> '' AND (ref_status = 'matched' OR EXISTS (SELECT 1 FROM ad WHERE ad.p_brand = mp.p_brand AND ad.clean_key = mp.clean_key)) AS hit FROM mp)
SELECT rr.p_brand, clean_key, count(*) AS "rows", count(*) FILTER (hit) AS matched, count(*) FILTER (NOT hit AND clean_key <> '') AS no_match, count(*) FILTER (NOT hit) AS to_review, coalesce(any_value(additions), 0) AS additions FROM rr LEFT JOIN li ON li.p_brand = rr.p_brand GROUP BY 1, 2""",
    "refresh_logged": imports._SNAP + """SELECT 'first' AS run_id, 'success' AS status, 1 AS version, count(*) AS added, 0 AS deleted, 0 AS modified, count(*) AS "rows", max(o_orderkey) AS greatest FROM od UNION ALL
 SELECT 'second', 'success', 2, (SELECT count(*) FROM df WHERE change = 'added'), (SELECT count(*) FROM df WHERE change = 'deleted'), (SELECT count(*) FROM df WHERE change = 'modified' AND changed_fields <> ''), count(*), max(o_orderkey) FROM nw""",
}
