"""Linkage queries over the test tables: parts as reference and master, line items as statements, brands as channels."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmatch.functions.text import id_text, numeric_zero, parse_amount
from quillmatch.functions.titles import KEYWORDS, PHRASES, CleaningPolicy, add_clean_key, add_master_title, drop_disabled
from quillmatch.operators import linkage as L
from quillmatch.operators.names import longest_contained
from quillmatch.operators.nearkeys import nearest_text
from quillmatch.operators.nearkeys import residual_partition as residual
from quillmatch.sources.reference import index_table
from quillmatch.sources.scratch import landed, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def few(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of a few rows, written down in the plan: Spark knows its size (a join broadcasts it by itself) and no Python worker makes it."""
    columns = [c.split() for c in schema.split(", ")]
    each = (F.struct(*(F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, columns, strict=True))) for r in rows)
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*each)))


def titled(parts: DataFrame) -> DataFrame:
    return parts.withColumn("title", F.concat(F.lit("[연재] "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("화")))


class Keys:
    """The tables of one query, with what its parts have in common: keys are made once for each part, never for each line, and kept as a table of
    the query's own; so is the reference."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @functools.cached_property
    def parts(self) -> DataFrame:
        return landed(add_clean_key(spread(titled(self.table("part"))), "title"))

    @functools.cached_property
    def reference(self) -> DataFrame:
        """As an index in buckets of its keys: whoever joins it has only the statements to move."""
        return index_table(reference(self), ["p_brand", "clean_key"])


def keyed_parts(k: Keys) -> DataFrame:
    return k.parts


def dated_parts(k: Keys) -> DataFrame:
    """Parts with two dates: the first only for some brands."""
    shipped = k.table("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_shipdate").alias("s"))
    out = keyed_parts(k).join(shipped, "p_partkey", "left")
    odd = F.col("p_partkey") % 3 == 0
    return out.withColumn("registered", F.when((F.col("p_size") > 25) & odd, F.col("s"))).withColumn("created", F.when(~odd, F.col("s")))


def reference(k: Keys) -> DataFrame:
    parts = dated_parts(k).where("p_size <= 25").withColumn("id", F.col("p_partkey").cast("string"))
    return L.candidate_index(parts, ["p_brand", "clean_key"], "id", "title", "p_partkey", ["registered", "created"])


def master(k: Keys) -> DataFrame:
    parts = keyed_parts(k).where("p_size between 10 and 40").withColumn("id", F.col("p_partkey").cast("string"))
    return L.candidate_index(parts, ["clean_key"], "id", "title", "p_partkey")


def statements(k: Keys) -> DataFrame:
    lines = k.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_tax")
    parts = keyed_parts(k).select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.when(F.col("p_partkey") % 97 == 0, F.lit("")).otherwise(F.col("clean_key")).alias("clean_key"))
    return lines.join(parts, "l_partkey")


def mapped(k: Keys, clustered: bool = False) -> DataFrame:
    return L.map_statements(statements(k), k.reference, ["p_brand", "clean_key"], master(k), clustered=clustered)


ROW = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def clean_title_parts(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return keyed_parts(k).select("p_partkey", "title", "clean_key")


def clean_title_docs(spark, sf_dir):
    return add_clean_key(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text").select("doc_id", "clean_key")


def master_title(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    t = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("<"), "p_name", F.lit(">_"), k)).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("_x_"), "p_brand", F.lit("_1_"), k, F.lit("_확정"))).otherwise(F.col("p_name"))
    return add_master_title(table(spark, sf_dir, "part").withColumn("t", t), "t").select("p_partkey", "master_title")


def scalar_parsing(spark, sf_dir):
    r = table(spark, sf_dir, "lineitem").select(*ROW, F.concat(F.col("l_quantity").cast("decimal(12,1)").cast("string")).alias("q"), F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 2 == 0, F.lit(".0")).otherwise(F.lit("원"))).alias("s"))
    return r.select(*ROW, id_text("q").alias("qty_id"), id_text("s").alias("part_id"), parse_amount("s").alias("amount"), numeric_zero("s").alias("zero"))


def drop_disabled_orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return drop_disabled(o, ["o_orderpriority"], CleaningPolicy(markers=("NOT SPECIFIED",))).select("o_orderkey", "o_orderpriority")


def candidate_index(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return reference(k)


def candidate_index_capped(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return master(k).select("clean_key", "status", "rows", "id_count", "selected_id", "selected_title", "ids", "titles")


def map_rows(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return mapped(k).select(*ROW, "p_brand", "clean_key", "ref_status", "ref_selected_id", "ref_id_count", "master_status", "master_selected_id", "review_reason", "review")


def map_review(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return mapped(k).where("review = 'Y'").select(*ROW, "review_reason")


def map_summary(spark, sf_dir):
    k = Keys(spark, sf_dir)
    dup = L.duplicates(k.reference, statements(k), ["p_brand", "clean_key"])
    return L.mapping_summary(mapped(k), dup)


def duplicate_candidates(spark, sf_dir):
    k = Keys(spark, sf_dir)
    dup = L.duplicates(k.reference, statements(k), ["p_brand", "clean_key"])
    return dup.select("p_brand", "clean_key", "id_count", "selected_id", "ids")


def exclude_missing(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    kept, gone = L.exclude(p, p.where("p_retailprice > 1500"), "p_partkey", "settlement missing")
    return kept.withColumn("excluded_reason", F.lit("")).unionByName(gone)


def guards(k: Keys):
    p = keyed_parts(k).withColumn("id", F.col("p_partkey").cast("string"))
    return p


def explained(k: Keys, other=False):
    p = guards(k)
    keys = ["p_brand", "clean_key"]
    pick = lambda lo, hi: L.evidence_index(p.where(f"p_size between {lo} and {hi}"), keys, ["id", "title"], "p_partkey")
    named = [("missing", pick(26, 32), keys, ["id", "title"]), ("service", pick(30, 38), keys, ["id", "title"]), ("billing", pick(36, 42), keys, ["id"])]
    named.append(("master", L.evidence_index(p.where("p_size <= 45"), ["clean_key"], ["id"], "p_partkey"), ["clean_key"], ["id"]))
    if other:
        named.insert(3, ("other_channel", L.evidence_index(p.where("p_size <= 25"), ["clean_key"], ["p_brand", "id"], "p_partkey"), ["clean_key"], ["p_brand", "id"]))
    return L.explain_no_match(mapped(k), named, channel="p_brand" if other else None)


def explain_no_match(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return explained(k).select(*ROW, "ref_status", "detail_reason", "split_reason", F.md5("detail_evidence").alias("evidence_md5"))


def other_channels(spark, sf_dir):
    k = Keys(spark, sf_dir)
    s = statements(k).select(*ROW, "p_brand", "clean_key")
    return L.with_other_channels(s, keyed_parts(k).where("p_size <= 25"), "clean_key", "p_brand").select(*ROW, "other_channels")


def gated(k: Keys):
    money = lambda c: F.when(F.col("l_orderkey") % 50 == 0, F.lit("")).otherwise(F.concat(F.format_number(F.round(F.col(c) * 100), 0), F.lit("원")))
    rows = explained(k).withColumns({"sale_text": money("l_extendedprice"), "base_text": money("l_discount"), "offset_text": money("l_tax")})
    return L.transfer_gate(rows, True, "sale_text", "base_text", "offset_text", blank_offset_as_zero=True)


def transfer_rows(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return gated(k).where("size(block_reasons) = 0").select(*ROW, "ref_selected_id", "sale", "base", "offset")


def transfer_blocked(spark, sf_dir):
    k = Keys(spark, sf_dir)
    return gated(k).where("size(block_reasons) > 0").select(*ROW, F.array_join("block_reasons", " | ").alias("block_reasons"))


def residual_partition(spark, sf_dir):
    k = Keys(spark, sf_dir)
    un = statements(k).join(k.reference, ["p_brand", "clean_key"], "left_anti")
    out = residual(un, keyed_parts(k).where("p_size <= 25"), "p_brand", "clean_key", "l_orderkey", least=0.65)
    return out.withColumn("nearest", nearest_text())


def near_titles(spark, sf_dir):
    """Titles with their brand (1,600 keys at most), by type: those that the reference lacks, by what is nearest."""
    p = table(spark, sf_dir, "part").withColumn("key", F.lower(F.regexp_replace(F.concat("p_name", "p_brand"), "[ #]", "")))
    ref = p.where("p_size <= 25")
    out = residual(p.where("p_size > 25").join(ref, ["p_type", "key"], "left_anti"), ref, "p_type", "key", "p_partkey", least=0.85, top=5)
    return out.withColumn("nearest", nearest_text())


def rule_impact(spark, sf_dir):
    k = Keys(spark, sf_dir)
    before = L.map_statements(statements(k), k.reference, ["p_brand", "clean_key"])
    short = lambda d: d.withColumn("clean_key", F.split("clean_key", "[aeiou]")[0])
    ref = short(keyed_parts(k).where("p_size <= 25")).withColumn("id", F.col("p_partkey").cast("string"))
    after = L.map_statements(short(statements(k)), L.candidate_index(ref, ["p_brand", "clean_key"], "id", "title", "p_partkey"), ["p_brand", "clean_key"])
    return L.rule_impact(before, after, ROW, groups=["p_brand"])


def detect_channel(spark, sf_dir):
    """Names with a brand, with a type instead (no channel there), with two brands; half of the brands are no channels, so that some names hold only the
    beginning of theirs. Aliases of one length and one rank go by text."""
    p = table(spark, sf_dir, "part")
    what = F.when(F.col("p_size") > 45, F.col("p_type")).when(F.col("p_size") > 40, F.concat("p_brand", F.lit(" Brand#11 Brand#12"))).otherwise(F.col("p_brand"))
    files = p.select("p_partkey", F.concat(F.lit("2026-02 "), what, F.lit(" report "), "p_size", F.lit(".xlsx")).alias("file"))
    brands = p.where("substr(p_brand, 7) < '2'").select("p_brand").union(p.select(F.concat(F.lit("and#"), F.substring("p_brand", 7, 1)))).distinct()
    return longest_contained(files, "file", brands, "p_brand").select("p_partkey", F.col("found").alias("channel"))


def _clean(e: str) -> str:
    """DuckDB: the key of an expression whose text NFKC leaves as it is."""
    t = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({e}, '^\s+|\s+$', '', 'g'), '\s*~[^~]+~\s*$', ''), '\s+\d+부(\s*-\s*[^\n]*)?$', ''), '^$', '')"
    u = rf"regexp_replace(regexp_replace(lower(regexp_replace(b, '\s*\d+/\d+$', '')), '(^|\s)제\s*\d+[권화]', ' ', 'g'), '[?~,\-_]', '', 'g')"
    u = rf"regexp_replace({u}, '\([^)]*\)|\[[^\]]*\]|【[^】]*】', '', 'g')"
    for phrase in PHRASES:
        u = f"replace({u}, '{phrase}', '')"
    u = rf"regexp_replace({u}, '\d+\s*[권화부회]', '', 'g')"
    for word in KEYWORDS:
        u = f"replace({u}, '{word}', '')"
    u = rf"regexp_replace(regexp_replace({u}, '\d+', '', 'g'), '\.+$', '')"
    u = rf"regexp_replace({u}, '[.,~\-–—!@#$%^&*_=+\\|/:;\x22''`<>?，｡､{{}}()\[\]]', '', 'g')"
    return f"(SELECT regexp_replace({u}, '\\s+', '', 'g') FROM (SELECT {t} AS b))"


def _residual(least: float, top: int) -> str:
    """DuckDB: res, from un(c, k, rows) and rd(rc, rk), by comparing all pairs."""
    return f"""al AS (SELECT c, k, rk, 1 - levenshtein(k, rk) / greatest(length(k), length(rk)) AS s, bool_or(rc = c) AS same, bool_or(rc <> c) AS other FROM un, rd GROUP BY c, k, rk),
nr AS (SELECT *, row_number() OVER (PARTITION BY c, k ORDER BY s DESC, same DESC, rk) AS n FROM al WHERE s >= {least}),
kd AS (SELECT c, k, bool_or(same) AS same, bool_or(other AND rk = k) AS exact, bool_or(other) AS other, max(s) AS score, string_agg(rk || ':' || CAST(floor(s * 1000 + 1e-6) AS BIGINT), ' | ' ORDER BY n) FILTER (n <= {top}) AS nearest FROM nr GROUP BY c, k),
res AS (SELECT un.*, CASE WHEN same THEN 'same_channel_fuzzy' WHEN exact THEN 'other_channel_exact' WHEN other THEN 'other_channel_fuzzy' ELSE 'absent' END AS kind, score, coalesce(nearest, '') AS nearest FROM un LEFT JOIN kd USING (c, k)) """


PART_SQL = f"""kp AS (SELECT *, {_clean("title")} AS clean_key FROM (SELECT *, '[연재] ' || p_name || ' ' || p_size || '화' AS title FROM part)),
"""
REF_SQL = f"""WITH {PART_SQL}
dp AS (SELECT kp.*, s, CASE WHEN p_size > 25 AND p_partkey % 3 = 0 THEN s END AS registered, CASE WHEN p_partkey % 3 <> 0 THEN s END AS created
       FROM kp LEFT JOIN (SELECT l_partkey, max(l_shipdate) AS s FROM lineitem GROUP BY 1) ON l_partkey = p_partkey WHERE p_size <= 25),
ch AS (SELECT *, CASE WHEN count(registered) OVER w > 0 THEN 'registered' WHEN count(created) OVER w > 0 THEN 'created' ELSE '' END AS basis FROM dp WINDOW w AS (PARTITION BY p_brand, clean_key)),
rk AS (SELECT *, row_number() OVER (PARTITION BY p_brand, clean_key ORDER BY d DESC NULLS LAST, p_partkey) AS rn FROM (SELECT *, CASE basis WHEN 'registered' THEN registered WHEN 'created' THEN created END AS d FROM ch)),
ref AS (SELECT p_brand, clean_key, 'matched' AS status, count(*) AS "rows", count(*) AS id_count, arg_min(CAST(p_partkey AS VARCHAR), rn) AS selected_id, arg_min(title, rn) AS selected_title,
        any_value(basis) AS basis, coalesce(arg_min(strftime(d, '%Y-%m-%d'), rn) FILTER (d IS NOT NULL), '') AS basis_value,
        string_agg(CAST(p_partkey AS VARCHAR), ' | ' ORDER BY rn) FILTER (rn <= 30) AS ids FROM rk GROUP BY p_brand, clean_key),
rt AS (SELECT p_brand, clean_key, string_agg(title, ' | ' ORDER BY f) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, clean_key ORDER BY f) AS tn FROM (SELECT p_brand, clean_key, title, min(rn) AS f FROM rk GROUP BY 1, 2, 3)) WHERE tn <= 30 GROUP BY 1, 2),
ms AS (SELECT clean_key, count(*) AS "rows", count(*) AS id_count, arg_min(CAST(p_partkey AS VARCHAR), p_partkey) AS selected_id, arg_min(title, p_partkey) AS selected_title,
       string_agg(CAST(p_partkey AS VARCHAR), ' | ' ORDER BY p_partkey) FILTER (n <= 30) AS ids
       FROM (SELECT *, row_number() OVER (PARTITION BY clean_key ORDER BY p_partkey) AS n FROM kp WHERE p_size BETWEEN 10 AND 40) GROUP BY 1),
mt AS (SELECT clean_key, string_agg(title, ' | ' ORDER BY f) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY clean_key ORDER BY f) AS tn FROM (SELECT clean_key, title, min(p_partkey) AS f FROM kp WHERE p_size BETWEEN 10 AND 40 GROUP BY 1, 2)) WHERE tn <= 30 GROUP BY 1),
st AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_discount, l_tax, p_brand, CASE WHEN p_partkey % 97 = 0 THEN '' ELSE clean_key END AS clean_key FROM lineitem JOIN kp ON l_partkey = p_partkey),
mp AS (SELECT st.*, CASE WHEN st.clean_key = '' THEN 'blank_key' WHEN ref.clean_key IS NULL THEN 'no_match' ELSE 'matched' END AS ref_status, coalesce(ref.selected_id, '') AS ref_selected_id, coalesce(ref.id_count, 0) AS ref_id_count,
       CASE WHEN st.clean_key = '' THEN 'blank_key' WHEN ms.clean_key IS NULL THEN 'no_match' ELSE 'matched' END AS master_status, coalesce(ms.selected_id, '') AS master_selected_id
       FROM st LEFT JOIN ref ON st.p_brand = ref.p_brand AND st.clean_key = ref.clean_key LEFT JOIN ms ON st.clean_key = ms.clean_key),
mr AS (SELECT *, concat_ws(' | ', CASE WHEN clean_key = '' THEN 'no key' END, CASE ref_status WHEN 'no_match' THEN 'ref not mapped' WHEN 'blank_key' THEN 'ref cannot be matched' END,
       CASE master_status WHEN 'no_match' THEN 'master not mapped' WHEN 'blank_key' THEN 'master cannot be matched' END) AS review_reason FROM mp),
ev AS (SELECT g, p_brand, clean_key, string_agg(CAST(p_partkey AS VARCHAR), ' | ' ORDER BY p_partkey) FILTER (n <= 30) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY g, p_brand, clean_key ORDER BY p_partkey) AS n FROM (
       SELECT 'missing' AS g, * FROM kp WHERE p_size BETWEEN 26 AND 32 UNION ALL SELECT 'service', * FROM kp WHERE p_size BETWEEN 30 AND 38 UNION ALL SELECT 'billing', * FROM kp WHERE p_size BETWEEN 36 AND 42)) GROUP BY 1, 2, 3),
et AS (SELECT g, p_brand, clean_key, string_agg(title, ' | ' ORDER BY f) AS titles FROM (SELECT g, p_brand, clean_key, title, min(p_partkey) AS f FROM (
       SELECT 'missing' AS g, * FROM kp WHERE p_size BETWEEN 26 AND 32 UNION ALL SELECT 'service', * FROM kp WHERE p_size BETWEEN 30 AND 38) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
em AS (SELECT clean_key, string_agg(CAST(p_partkey AS VARCHAR), ' | ' ORDER BY p_partkey) FILTER (n <= 30) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY clean_key ORDER BY p_partkey) AS n FROM kp WHERE p_size <= 45) GROUP BY 1),
ex AS (SELECT mr.*, m.ids AS m_ids, mtt.titles AS m_t, CASE WHEN m.ids IS NULL THEN s.ids END AS s_ids, stt.titles AS s_t, b.ids AS b_ids, em.ids AS e_ids FROM mr
       LEFT JOIN ev m ON m.g = 'missing' AND m.p_brand = mr.p_brand AND m.clean_key = mr.clean_key LEFT JOIN et mtt ON mtt.g = 'missing' AND mtt.p_brand = mr.p_brand AND mtt.clean_key = mr.clean_key
       LEFT JOIN ev s ON s.g = 'service' AND s.p_brand = mr.p_brand AND s.clean_key = mr.clean_key LEFT JOIN et stt ON stt.g = 'service' AND stt.p_brand = mr.p_brand AND stt.clean_key = mr.clean_key
       LEFT JOIN ev b ON b.g = 'billing' AND b.p_brand = mr.p_brand AND b.clean_key = mr.clean_key LEFT JOIN em ON em.clean_key = mr.clean_key),
xp AS (SELECT *, CASE ref_status WHEN 'matched' THEN '' WHEN 'blank_key' THEN 'no key' ELSE coalesce(nullif(concat_ws(' | ', CASE WHEN m_ids IS NOT NULL THEN 'missing' END, CASE WHEN s_ids IS NOT NULL THEN 'service' END, CASE WHEN b_ids IS NOT NULL THEN 'billing' END, CASE WHEN e_ids IS NOT NULL THEN 'master' END), ''), 'no candidate') END AS detail_reason,
       CASE WHEN ref_status = 'no_match' THEN concat_ws(' | ', CASE WHEN m_ids IS NOT NULL THEN 'missing' END, CASE WHEN b_ids IS NOT NULL THEN 'billing' END) ELSE '' END AS split_reason,
       CASE WHEN ref_status <> 'no_match' THEN '' ELSE coalesce(nullif(concat_ws(' || ', 'missing: id=' || m_ids || ', title=' || m_t, 'service: id=' || s_ids || ', title=' || s_t, 'billing: id=' || b_ids, 'master: id=' || e_ids), ''), 'key=' || clean_key) END AS evidence FROM ex),
tg AS (SELECT *, l_orderkey % 50 = 0 AS blank, concat_ws(' | ', CASE WHEN ref_status <> 'matched' THEN 'not matched' END, CASE WHEN ref_id_count > 1 THEN 'several candidates' END, CASE WHEN split_reason <> '' THEN 'split reason' END,
       CASE WHEN ref_selected_id = '' THEN 'no id' END, CASE WHEN l_orderkey % 50 = 0 THEN 'sale not numeric' END, CASE WHEN l_orderkey % 50 = 0 THEN 'base not numeric' END) AS block_reasons FROM xp)
"""
R = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

QUERIES = {
    "clean_title_parts": clean_title_parts, "clean_title_docs": clean_title_docs, "master_title": master_title, "scalar_parsing": scalar_parsing, "drop_disabled": drop_disabled_orders,
    "candidate_index": candidate_index, "candidate_index_capped": candidate_index_capped, "map_rows": map_rows, "map_review": map_review, "map_summary": map_summary,
    "duplicate_candidates": duplicate_candidates, "exclude_missing": exclude_missing, "explain_no_match": explain_no_match, "other_channels": other_channels,
    "transfer_rows": transfer_rows, "transfer_blocked": transfer_blocked, "residual_partition": residual_partition, "near_titles": near_titles, "rule_impact": rule_impact, "detect_channel": detect_channel,
}

ORACLE_SQL = {
    "clean_title_parts": f"WITH {PART_SQL} z AS (SELECT 1) SELECT p_partkey, title, clean_key FROM kp",
    "clean_title_docs": f"SELECT doc_id, {_clean('text')} AS clean_key FROM documents",
    "master_title": "SELECT p_partkey, p_name || CASE WHEN p_partkey % 3 = 1 THEN '_x' ELSE '' END AS master_title FROM part",
    "scalar_parsing": f"SELECT {R}, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS qty_id, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) ELSE l_partkey || '원' END AS part_id, CAST(l_partkey AS DOUBLE) AS amount, l_partkey = 0 AS zero FROM lineitem",
    "drop_disabled": "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT LIKE '%NOT SPECIFIED%'",
    "candidate_index": REF_SQL + 'SELECT ref.p_brand, ref.clean_key, status, "rows", id_count, selected_id, selected_title, basis, basis_value, ids, titles FROM ref JOIN rt USING (p_brand, clean_key)',
    "candidate_index_capped": REF_SQL + "SELECT clean_key, 'matched' AS status, \"rows\", id_count, selected_id, selected_title, ids, titles FROM ms JOIN mt USING (clean_key)",
    "map_rows": REF_SQL + f"SELECT {R}, p_brand, clean_key, ref_status, ref_selected_id, ref_id_count, master_status, master_selected_id, review_reason, CASE WHEN review_reason <> '' THEN 'Y' ELSE 'N' END AS review FROM mr",
    "map_review": REF_SQL + f"SELECT {R}, review_reason FROM mr WHERE review_reason <> ''",
    "map_summary": REF_SQL + "SELECT 'rows' AS item, count(*) AS value FROM mr UNION ALL SELECT 'review', count(*) FROM mr WHERE review_reason <> '' UNION ALL SELECT 'ref ' || s, (SELECT count(*) FROM mr WHERE ref_status = s) FROM (VALUES ('matched'), ('ambiguous'), ('no_match'), ('blank_key')) t(s) UNION ALL SELECT 'master ' || s, (SELECT count(*) FROM mr WHERE master_status = s) FROM (VALUES ('matched'), ('ambiguous'), ('no_match'), ('blank_key'), ('skipped')) t(s) UNION ALL SELECT 'duplicate keys', (SELECT count(*) FROM ref WHERE id_count > 1 AND EXISTS (SELECT 1 FROM st WHERE st.p_brand = ref.p_brand AND st.clean_key = ref.clean_key))",
    "duplicate_candidates": REF_SQL + "SELECT p_brand, clean_key, id_count, selected_id, ids FROM ref WHERE id_count > 1 AND EXISTS (SELECT 1 FROM st WHERE st.p_brand = ref.p_brand AND st.clean_key = ref.clean_key)",
    "exclude_missing": "SELECT p_partkey, p_retailprice, CASE WHEN p_retailprice > 1500 THEN 'settlement missing' ELSE '' END AS excluded_reason FROM part",
    "explain_no_match": REF_SQL + f"SELECT {R}, ref_status, detail_reason, split_reason, md5(evidence) AS evidence_md5 FROM xp",
    "other_channels": REF_SQL + f", oc AS (SELECT DISTINCT clean_key, p_brand FROM kp WHERE p_size <= 25) SELECT {R}, coalesce((SELECT string_agg(oc.p_brand, ' | ' ORDER BY oc.p_brand) FROM oc WHERE oc.clean_key = st.clean_key AND oc.p_brand <> st.p_brand), '') AS other_channels FROM st",
    "transfer_rows": REF_SQL + f'SELECT {R}, ref_selected_id, round(l_extendedprice * 100) AS sale, round(l_discount * 100) AS base, round(l_tax * 100) AS "offset" FROM tg WHERE block_reasons = \'\'',
    "transfer_blocked": REF_SQL + f"SELECT {R}, block_reasons FROM tg WHERE block_reasons <> ''",
    "residual_partition": REF_SQL + """, un AS (SELECT p_brand AS c, clean_key AS k, count(*) AS "rows" FROM st WHERE clean_key <> '' AND NOT EXISTS (SELECT 1 FROM ref WHERE ref.p_brand = st.p_brand AND ref.clean_key = st.clean_key) GROUP BY 1, 2),
rd AS (SELECT DISTINCT p_brand AS rc, clean_key AS rk FROM kp WHERE p_size <= 25 AND clean_key <> ''), """ + _residual(0.65, 3) + "SELECT c AS p_brand, k AS clean_key, \"rows\", kind, score, nearest FROM res",
    "near_titles": """WITH p AS (SELECT *, lower(regexp_replace(p_name || p_brand, '[ #]', '', 'g')) AS key FROM part), rd AS (SELECT DISTINCT p_type AS rc, key AS rk FROM p WHERE p_size <= 25),
un AS (SELECT p_type AS c, key AS k, count(*) AS "rows" FROM p WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM rd WHERE rc = p_type AND rk = key) GROUP BY 1, 2), """ + _residual(0.85, 5) + "SELECT c AS p_type, k AS key, \"rows\", kind, score, nearest FROM res",
    "rule_impact": REF_SQL + f""", sh AS (SELECT DISTINCT p_brand, regexp_extract(clean_key, '^[^aeiou]*') AS k FROM kp WHERE p_size <= 25),
 af AS (SELECT mp.p_brand, ref_status, CASE WHEN regexp_extract(clean_key, '^[^aeiou]*') = '' THEN 'blank_key' WHEN EXISTS (SELECT 1 FROM sh WHERE sh.p_brand = mp.p_brand AND sh.k = regexp_extract(clean_key, '^[^aeiou]*')) THEN 'matched' ELSE 'no_match' END AS new_status FROM mp)
SELECT p_brand, ref_status AS old_status, new_status, count(*) AS "rows" FROM af WHERE ref_status <> new_status GROUP BY ALL""",
    "detect_channel": """WITH f AS (SELECT p_partkey, '2026-02 ' || CASE WHEN p_size > 45 THEN p_type WHEN p_size > 40 THEN p_brand || ' Brand#11 Brand#12' ELSE p_brand END || ' report ' || p_size || '.xlsx' AS file FROM part),
b AS (SELECT DISTINCT p_brand AS w FROM part WHERE substr(p_brand, 7) < '2' UNION SELECT 'and#' || substr(p_brand, 7, 1) FROM part)
SELECT p_partkey, coalesce((SELECT w FROM b WHERE contains(file, w) ORDER BY length(w) DESC, w LIMIT 1), '') AS channel FROM f""",
}
