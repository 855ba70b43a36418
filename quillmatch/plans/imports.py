"""Queries about what comes in: files and their channels, adapters, layouts, masters, refreshed lookups, over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmatch.functions.text import field_candidates
from quillmatch.operators import audit as A
from quillmatch.operators import gates, names, sheets
from quillmatch.operators import linkage as L
from quillmatch.operators import refresh as R
from quillmatch.plans import statements
from quillmatch.plans.linkage import few, table
from quillmatch.sources import io


def channel_rules(spark, sf_dir):
    """Two rules a brand (none for Brand#25): names with two words take brands by token, names with one take the brand itself."""
    p = table(spark, sf_dir, "part")
    none = F.array().cast("array<string>")
    rule = lambda pos, tokens, exact, inc, exc: F.struct(F.lit(pos).alias("pos"), tokens.alias("tokens"), exact.alias("exact"), inc.alias("include"), exc.alias("exclude"))
    each = F.array(rule(0, F.array(F.lit("blue"), F.lit("bolt")), none, F.array(F.lit("#1")), F.array(F.lit("9"))), rule(1, F.array(F.lit("red")), F.array("p_brand"), none, none))
    rules = p.where("p_brand <> 'Brand#25'").select("p_brand").distinct().select(F.col("p_brand").alias("platform"), F.explode(each).alias("x")).select("platform", "x.*")
    chosen = A.choose_rule(p.select("p_partkey", F.col("p_brand").alias("platform"), "p_name"), rules, "p_name")
    return A.channels_for(chosen, "p_partkey", p, "p_brand")


def detect_channel_segments(spark, sf_dir):
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.concat(F.lit("2026-02__"), "p_brand", F.lit("__x Brand#25.xlsx"))).when(k == 1, F.concat(F.lit("in/2026 report "), "p_brand", F.lit(" .xlsx"))).otherwise("Brand#1/report.xlsx")
    p = table(spark, sf_dir, "part")
    channels = p.select("p_brand", F.concat(F.lit("P"), F.substring("p_brand", 7, 1)).alias("platform")).distinct()
    return _assigned(names.detect_channel(p.select("p_partkey", name.alias("file")), "file", channels, "p_brand", "platform"))


def _assigned(files):
    return L.assign_channels(files).select("p_partkey", "channel", "platform", "applied", "status")


def detect_platform(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    aliases = p.where("p_brand = 'Brand#1'").select(F.col("p_brand").alias("platform"), F.lit("Blue").alias("alias"), F.lit(0).alias("pos")).distinct()
    return names.detect_platform(p.select("p_partkey", F.concat("p_name", F.lit(" "), "p_brand").alias("file")), "file", aliases, p.select(F.col("p_brand").alias("platform")).distinct()).select("p_partkey", "platform")


def lookups(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.col("o_custkey").cast("string"), F.lit(".0")).alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.concat(F.lit("<"), "o_orderpriority", F.lit(">_1")).alias("title"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".0")).alias("master_id"), F.col("o_orderpriority").alias("author_a"), F.col("o_orderstatus").alias("Writer"), F.col("o_orderpriority").alias("작가"), "o_orderkey")


def audit_snapshot(spark, sf_dir):
    return R.audit_snapshot(lookups(spark, sf_dir), "id", "day", ["o_orderkey"], "title", ["master_id", "absent"])


def refreshed(spark, sf_dir):
    rows = lookups(spark, sf_dir)
    return R.refresh_lookup(rows.where("o_orderkey % 10 <> 1"), rows.where("o_orderkey % 10 <> 2"), "id", "day", ["o_orderkey"], "title", ["master_id"])


def refresh_lookup(spark, sf_dir):
    return refreshed(spark, sf_dir).changes.select("id", "change", F.array_join("changed_fields", ",").alias("changed_fields"), "old_title", "new_title")


def refresh_changes(spark, sf_dir):
    return refreshed(spark, sf_dir).summary


def history_view(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("mode"))
    return A.history_view(runs, {"run_id": "id", "status": "state", "mode": "scope", "absent": "absent"}, {"status": {"F": "finished", "O": "open"}}, 100)


def load_status(spark, sf_dir):
    k = F.col("o_orderkey")
    df = table(spark, sf_dir, "orders").select(F.when(k % 9 == 0, F.lit(" ")).otherwise(F.concat(k.cast("string"), F.lit(".0"))).alias("id"), F.col("o_orderstatus").alias("status"))
    return gates.load_status(df, "id", "status")


def normalize_frame(spark, sf_dir):
    k = F.col("event_id")
    return R.normalize_frame(table(spark, sf_dir, "events").select(F.when(k % 7 > 0, F.col("event_type")).alias(" event \n type "), F.when(k % 14 > 0, F.col("user_id")).alias("user_id")))


def split_master(spark, sf_dir):
    return R.split_master(table(spark, sf_dir, "part"), ["p_partkey", "p_brand", "p_type"], "p_brand", "Brand#2", "p_type", {"ECONOMY": "novel", "SMALL": "webtoon"})


def sheet_cells(spark, sf_dir):
    """The order sheets as files of two platforms."""
    return statements.cells(spark, sf_dir, F.concat("sheet", F.lit(".xlsx"))).withColumn("platform", F.when(F.col("sheet") < "3", "A").otherwise("B"))


def drop_blocked_columns(spark, sf_dir):
    c = sheet_cells(spark, sf_dir)
    blocked = few(spark, [("A", "No-te"), ("B", "isbn")], "platform string, word string")
    left = sheets.drop_blocked_columns(c, sheets.find_header(c, statements.candidates(spark)), blocked)
    return left.groupBy("sheet", "col").agg(F.count("*").alias("cells"))


def field_rules(spark, sf_dir):
    rule = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("거래내용 "), "p_name")).otherwise(F.concat("p_brand", F.lit(" 후보 또는 "), "p_name", F.lit(" x "), "p_type", F.lit(", 정책 금액/ . ")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(field_candidates(rule), "|").alias("headers"))


def normalize_registry(spark, sf_dir):
    adapters = [("A", "Title", "Customer", "없음", "Sale Amount", "contract a", "locked", "open"), ("B", "Name / Title 후보", "없음", "Customer 또는 ISBN", "sale-amount", "contract b", "candidate", "closed")]
    registry = few(spark, adapters, "platform string, title_from string, author_from string, external_id_from string, sale_from string, parser_contract string, amount_rule_status string, s2_gate string")
    c = sheet_cells(spark, sf_dir)
    rows = sheets.standardize(c, sheets.registry_candidates(registry), repeated=True)
    files = c.select("source_file", "platform").distinct().withColumn("file_status", F.lit("include"))
    return sheets.statement_rows(rows, files, registry).drop("base", "offset")


def drop_platform_totals(spark, sf_dir):
    rules = few(spark, [("Brand#2", "small", "ring"), ("Brand#2", "red", ""), ("Brand#3", "x", "y")], "platform string, prefix string, suffix string")
    return sheets.drop_platform_totals(table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("platform"), F.col("p_name").alias("title")), rules)


def row_numbers(spark, sf_dir):
    return sheets.row_numbers(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"])


def legacy_rows(spark, sf_dir):
    """A file for each priority and customer, with one sheet or two; files of low priority have no column of mapped ids."""
    o = table(spark, sf_dir, "orders").withColumn("file", F.concat("o_orderpriority", F.lit(" "), F.col("o_custkey").cast("string")))
    o = o.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy("o_orderkey")) + 1)
    data = F.array(F.struct(F.lit(1).alias("col"), F.when(F.col("o_orderkey") % 3 == 0, "nan").otherwise(F.col("o_orderkey").cast("string")).alias("value")), F.struct(F.lit(2).alias("col"), F.col("o_orderstatus").alias("value")))
    body = o.select(F.col("file").alias("source_file"), "row", F.explode(data).alias("c")).select("source_file", "row", "c.*")
    head = F.array(F.struct(F.lit(1).alias("col"), F.when(F.col("source_file") < "5", "매핑_판매채널콘텐츠ID").otherwise("other").alias("value")), F.struct(F.lit(2).alias("col"), F.lit("").alias("value")))
    heads = body.select("source_file").distinct().select("source_file", F.lit(1).alias("row"), F.explode(head).alias("c")).select("source_file", "row", "c.*")
    sheet = F.when(F.col("source_file") < "3", F.array(F.lit("A"), F.lit("Sheet1"))).otherwise(F.array(F.lit("data"), F.lit("extra")))
    cells = body.unionByName(heads).withColumn("sheet", F.explode(sheet))
    return sheets.legacy_rows(cells, ["매핑_판매채널콘텐츠ID", "S2_판매채널콘텐츠ID"])


def payment_layout(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return io.load_payment([o.select("o_totalprice"), o.select("o_orderkey", "o_orderstatus")], ["id", "status"], {"id": "o_orderkey", "status": "o_orderstatus"})


def discover(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("in/2026-0"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("/"), "p_name", F.lit(".xlsx")).alias("path"))
    return io.discover(files, "blue", "2026-03").select("p_partkey", "period")


QUERIES = {
    "channel_rules": channel_rules, "detect_channel_segments": detect_channel_segments, "detect_platform": detect_platform, "audit_snapshot": audit_snapshot, "refresh_lookup": refresh_lookup, "refresh_changes": refresh_changes,
    "history_view": history_view, "load_status": load_status, "normalize_frame": normalize_frame, "split_master": split_master, "drop_blocked_columns": drop_blocked_columns, "field_rules": field_rules,
    "normalize_registry": normalize_registry, "drop_platform_totals": drop_platform_totals, "row_numbers": row_numbers, "legacy_rows": legacy_rows, "payment_layout": payment_layout, "discover": discover,
}

_SNAP = """WITH lk AS (SELECT CAST(o_custkey AS VARCHAR) AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS title, CAST(o_orderkey AS VARCHAR) AS master_id, o_orderpriority || ' | ' || o_orderstatus AS authors, o_orderkey FROM orders),
od AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC, o_orderkey) AS n FROM lk WHERE o_orderkey % 10 <> 1) WHERE n = 1),
nw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY day DESC, o_orderkey) AS n FROM lk WHERE o_orderkey % 10 <> 2) WHERE n = 1),
df AS (SELECT coalesce(od.id, nw.id) AS id, od.title AS old_title, nw.title AS new_title, concat_ws(',', CASE WHEN od.title <> nw.title THEN 'title' END, CASE WHEN od.master_id <> nw.master_id THEN 'master_id' END, CASE WHEN od.authors <> nw.authors THEN 'authors' END) AS changed_fields,
 CASE WHEN od.id IS NULL THEN 'added' WHEN nw.id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM od FULL JOIN nw ON od.id = nw.id)
"""

ORACLE_SQL = {
    "channel_rules": "WITH f AS (SELECT p_partkey, p_brand, CASE WHEN p_brand = 'Brand#25' THEN 'all' WHEN contains(p_name, 'blue') AND contains(p_name, 'bolt') THEN 'tokens' WHEN contains(p_name, 'red') THEN 'own' ELSE 'all' END AS r FROM part), b AS (SELECT DISTINCT p_brand AS c FROM part) SELECT p_partkey, c AS p_brand FROM f, b WHERE r = 'all' OR (r = 'own' AND c = p_brand) OR (r = 'tokens' AND contains(c, '#1') AND NOT contains(c, '9'))",
    "detect_channel_segments": "SELECT p_partkey, c AS channel, CASE WHEN c = '' THEN '' ELSE 'P' || substr(c, 7, 1) END AS platform, c AS applied, CASE WHEN c = '' THEN 'choose' ELSE 'ok' END AS status FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN '' ELSE p_brand END AS c FROM part)",
    "detect_platform": "SELECT p_partkey, CASE WHEN contains(p_name, 'blue') THEN 'Brand#1' ELSE p_brand END AS platform FROM part",
    "audit_snapshot": "SELECT CAST(o_custkey AS VARCHAR) AS id, o_orderpriority AS title, CAST(o_orderkey AS VARCHAR) AS master_id, '' AS absent, o_orderpriority || ' | ' || o_orderstatus AS authors FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
    "refresh_lookup": _SNAP + "SELECT id, change, CASE WHEN change = 'modified' THEN changed_fields ELSE '' END AS changed_fields, old_title, new_title FROM df WHERE change <> 'modified' OR changed_fields <> ''",
    "refresh_changes": _SNAP + "SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'modified' AND changed_fields <> '') AS modified FROM df",
    "history_view": "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS state, o_orderpriority AS scope FROM orders ORDER BY o_orderkey DESC LIMIT 100",
    "load_status": "SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 9 <> 0",
    "normalize_frame": "SELECT CASE WHEN event_id % 7 > 0 THEN event_type END AS \"event type\", CASE WHEN event_id % 14 > 0 THEN user_id END AS user_id FROM events WHERE event_id % 14 > 0",
    "split_master": "SELECT p_partkey, p_brand, p_type, CASE p_type WHEN 'ECONOMY' THEN 'novel' WHEN 'SMALL' THEN 'webtoon' ELSE 'other' END AS class FROM part WHERE p_brand = 'Brand#2'",
    "drop_blocked_columns": statements._ROWS + "SELECT sheet, CAST(c AS INT) AS col, count(*) + CASE WHEN c = 1 THEN any_value(top) ELSE 1 END AS cells FROM s, range(1, 6) t(c) WHERE NOT (o_orderpriority < '3' AND c = 5) GROUP BY sheet, c",
    "field_rules": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '거래내용' ELSE p_brand || '|' || p_name || '|' || p_type END AS headers FROM part",
    "normalize_registry": statements._ROWS + "SELECT CASE WHEN sheet < '3' THEN 'A' ELSE 'B' END AS platform, sheet || '.xlsx' AS source_file, sheet, r AS source_row, 'include' AS file_status, CASE WHEN low THEN 'no_amount' ELSE 'parsed' END AS row_status, 'order ' || o_orderkey AS title, CASE WHEN sheet < '3' THEN CAST(o_custkey AS VARCHAR) ELSE '' END AS author, CASE WHEN sheet < '3' THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS external_id, CASE WHEN low THEN '' ELSE format('{:,}', CAST(round(o_totalprice) AS BIGINT)) || '원' END AS sale, 'order' AS clean_key, CASE WHEN sheet < '3' THEN 'contract a' ELSE 'contract b' END AS parser_contract, CASE WHEN sheet < '3' THEN 'locked' ELSE 'candidate' END AS amount_rule_status, CASE WHEN sheet < '3' THEN 'open' ELSE 'closed' END AS s2_gate FROM s WHERE NOT again",
    "drop_platform_totals": "SELECT p_partkey, p_brand AS platform, p_name AS title FROM part WHERE NOT (p_brand = 'Brand#2' AND (p_name LIKE 'small%ring' OR p_name LIKE 'red%'))",
    "row_numbers": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no FROM orders",
    "legacy_rows": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderkey) + 1 AS r FROM orders) SELECT o_orderpriority || ' ' || o_custkey AS source_file, CASE WHEN o_orderpriority < '3' THEN 'Sheet1' ELSE 'data' END AS sheet, r AS \"row\", CAST(c AS INT) AS col, CASE WHEN c = 2 THEN 'column_2' WHEN o_orderpriority < '5' THEN '매핑_판매채널콘텐츠ID' ELSE 'other' END AS header, CASE WHEN c = 2 THEN o_orderstatus WHEN o_orderkey % 3 = 0 THEN 'nan' ELSE CAST(o_orderkey AS VARCHAR) END AS value FROM o, range(1, 3) t(c) WHERE o_orderpriority >= '5' OR o_orderkey % 3 <> 0",
    "payment_layout": "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders",
    "discover": "SELECT p_partkey, '2026-03' AS period FROM part WHERE p_size % 9 = 2 AND contains(p_name, 'blue')",
}
