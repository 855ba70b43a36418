"""Sheets built from orders (one for each priority and customer, with one or two banner rows, a header and perhaps a second section) and read
back; workbooks written from customers and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.operators import audit as A
from quillmatch.operators import sheets as S
from quillmatch.plans.linkage import few, table
from quillmatch.sources import io, scratch
from quillmatch.sources.workbooks import read_workbooks, write_workbooks

HEADERS = ["Customer", "Title", "Sale Amount", "Title", "Note"]
CANDIDATES = [("title", "title", 0), ("title", "name", 1), ("author", "customer", 0), ("sale", "sale-amount", 0), ("external_id", "no such", 0)]


def candidates(spark) -> DataFrame:
    return few(spark, CANDIDATES, "field string, header string, pos int")


def cells(spark, sf_dir, file=None) -> DataFrame:
    """A banner (two rows in urgent sheets), the header (another name of the amount in low ones), then orders; a row of an order key divisible by 50
    repeats the header. All sheets are in one file, or in the one that the column `file` names. Orders move once, to the task of their sheet; banner and header come with a sheet's first order."""
    o = table(spark, sf_dir, "orders").withColumn("sheet", F.concat("o_orderpriority", F.lit(" "), F.col("o_custkey").cast("string")))
    by = ["sheet"] if file is None else S.SHEET  # a constant is no key to deal out by
    o = scratch.dealt(o.withColumn("source_file", F.lit("f.xlsx") if file is None else file), by)
    head = F.when(F.col("sheet").startswith("1-"), 3).otherwise(2)
    names = [F.when(F.col("sheet").startswith("5-"), "Amount").otherwise(h) if h == "Sale Amount" else F.lit(h) for h in HEADERS]
    o = o.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("o_orderkey")))
    again = F.col("o_orderkey") % 50 == 0
    data = [F.col("o_custkey").cast("string"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), F.concat(F.format_number(F.round("o_totalprice"), 0), F.lit("원")), F.lit("x"), F.lit(None).cast("string")]
    cell = lambda row, at, value: F.struct(row.alias("row"), F.lit(at).alias("col"), value.alias("value"))
    body = F.array(*(cell(F.col("n") + head, i, F.when(again, h).otherwise(d)) for i, (h, d) in enumerate(zip(names, data, strict=True), 1)))
    banner = F.transform(F.sequence(F.lit(1), head - 1), lambda r: cell(r, 1, F.lit("Sales of the month")))
    top = F.concat(banner, F.array(*(cell(head, i, h) for i, h in enumerate(names, 1))))
    return o.select(*S.SHEET, F.inline(F.when(F.col("n") == 1, F.concat(top, body)).otherwise(body)))


def workbooks(spark, sf_dir) -> str:
    """A workbook for each nation with a sheet for each market segment, written below the session's scratch folder: a merged banner, the header in row 2
    (3 in every fifth nation), customers, a total. -> its folder."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.select(F.concat("n_name", F.lit(".xlsx")).alias("source_file"), F.col("c_mktsegment").alias("sheet"), F.when(F.col("n_nationkey") % 5 == 0, 3).otherwise(2).alias("head"), "c_custkey", "c_name", "c_acctbal")
    c = c.withColumn("row", F.row_number().over(Window.partitionBy("source_file", "sheet").orderBy("c_custkey")) + F.col("head"))
    cell = lambda at, v, kind: F.struct(F.lit(at).alias("col"), v.alias("value"), F.lit(kind).alias("value_type"))
    data = F.array(cell(1, F.col("c_custkey").cast("string"), "number"), cell(2, F.concat(F.lit("[연재] "), "c_name"), "text"), cell(3, F.format_number("c_acctbal", 2), "text"))
    body = c.select("source_file", "sheet", "row", F.explode(data).alias("c"))
    ends = c.groupBy("source_file", "sheet", "head").agg(F.max("row").alias("last"))
    names = F.array(cell(1, F.lit("Ｃｏｄｅ"), "text"), cell(2, F.lit("Ti-tle"), "text"), cell(3, F.lit("Sale (KRW)"), "text"))
    extra = ends.select("source_file", "sheet", F.lit(1).alias("row"), F.explode(F.array(cell(1, F.lit("Sales"), "text"))).alias("c")).unionAll(ends.select("source_file", "sheet", "head", F.explode(names)))
    extra = extra.unionAll(ends.select("source_file", "sheet", F.col("last") + 1, F.explode(F.array(cell(2, F.lit("total"), "text"), cell(3, F.col("last").cast("string"), "number")))))
    path = scratch.folder(spark, "workbooks")
    write_workbooks(body.unionAll(extra).select("source_file", "sheet", "row", "c.*"), path)
    return path


def workbook_sheet(spark, sf_dir):
    """One sheet of every workbook, as rows; the others aren't opened."""
    rows = io.sheet_table(read_workbooks(spark, workbooks(spark, sf_dir), sheet="BUILDING"))
    get = lambda i: F.try_element_at("cells", F.lit(i))
    return rows.select(F.regexp_extract("source_file", "([^/]*)$", 1).alias("file"), "row", get(1).alias("code"), get(2).alias("title"), get(3).alias("sale"))


ADAPTERS = [("even", "Title", "없음", "code / ISBN", "Sale(KRW) 후보", "single_header", "locked", "open"), ("odd", "Title / Name", "없음", "없음", "amount 또는 sale (krw)", S.REPEATED, "candidate", "closed")]


def normalized(spark, sf_dir):
    registry = few(spark, ADAPTERS, "platform string, title_from string, author_from string, external_id_from string, sale_from string, parser_contract string, amount_rule_status string, s2_gate string")
    cells, merges = io.split_merges(scratch.landed(read_workbooks(spark, workbooks(spark, sf_dir))))
    cells = cells.withColumn("source_file", F.regexp_extract("source_file", "([^/]*)$", 1))
    n = table(spark, sf_dir, "nation")
    files = n.select(F.concat("n_name", F.lit(".xlsx")).alias("source_file"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("platform"), F.when(F.col("n_name") == "NATION_7", "excluded_by_rule").otherwise("include").alias("file_status"))
    scope = few(spark, [("even", None, "^MACH"), ("odd", "ING$", None), ("odd", "MOBILE", None)], "platform string, wanted string, unwanted string")
    return S.normalize_statements(cells, merges, files, registry, scope, exact=["total"])


def normalize_workbooks(spark, sf_dir):
    return normalized(spark, sf_dir)[0].drop("author", "base", "offset")


def workbook_audit(spark, sf_dir):
    return normalized(spark, sf_dir)[1]


def header_detect(spark, sf_dir):
    return S.find_header(cells(spark, sf_dir), candidates(spark))


def sections(spark, sf_dir):
    c = S.sections(cells(spark, sf_dir), candidates(spark))
    return c.groupBy("sheet", "header_row").agg(F.count_distinct("row").alias("rows"))


def normalize_cells(spark, sf_dir):
    rows = S.standardize(cells(spark, sf_dir), candidates(spark), repeated=True)
    kept = S.drop_non_data(rows, ["Title", "total"], ["0000"])
    files = few(spark, [("f.xlsx", "include")], "source_file string, file_status string")
    return S.feed(kept, files).select("sheet", "source_row", "title", "author", "external_id", "sale_amount")


def sheet_audit(spark, sf_dir):
    c = cells(spark, sf_dir)
    return S.audit(S.standardize(c, candidates(spark)), c)


def platform_audit(spark, sf_dir):
    """The workbooks' platforms: odd ones with an adapter that finds no header in nations 1 to 9, even ones, and one without files."""
    rows, sheets = normalized(spark, sf_dir)
    torn = F.col("source_file").rlike("_[13579]\\.") & (F.col("status") == "parsed")
    sheets = scratch.landed(sheets.withColumns({"status": F.when(torn, "header_not_found").otherwise(F.col("status")), "parsed_rows": F.when(torn, 0).otherwise(F.col("parsed_rows"))}))
    rows = scratch.landed(rows.where(~F.col("source_file").rlike("_[13579]\\.")))  # read four times
    registry = few(spark, [("even", "x", "candidate_confirmed_after_reconcile"), ("odd", "x", "needs_policy"), ("spare", "non_s2_source_blocked", "blocked")], "platform string, final_class string, amount_rule_status string")
    return A.platform_audit(A.file_states(sheets, rows), rows, registry)


QUERIES = {"platform_audit": platform_audit, "header_detect": header_detect, "sections": sections, "normalize_cells": normalize_cells, "sheet_audit": sheet_audit, "workbook_sheet": workbook_sheet, "normalize_workbooks": normalize_workbooks, "workbook_audit": workbook_audit}

_ROWS = "WITH p AS (SELECT *, o_orderpriority || ' ' || o_custkey AS sheet, CASE WHEN o_orderpriority LIKE '1-%' THEN 3 ELSE 2 END AS top, o_orderkey % 50 = 0 AS again FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY sheet ORDER BY o_orderkey) + top AS r FROM p), s AS (SELECT *, coalesce(max(CASE WHEN again THEN r END) OVER (PARTITION BY sheet ORDER BY r), top) AS h, o_orderpriority LIKE '5-%' AS low FROM o) "
_BOOKS = """WITH c AS (SELECT *, n_name || '.xlsx' AS f, n_nationkey % 2 = 0 AS even, CASE WHEN n_nationkey % 5 = 0 THEN 3 ELSE 2 END AS top FROM customer JOIN nation ON c_nationkey = n_nationkey),
b AS (SELECT *, row_number() OVER (PARTITION BY f, c_mktsegment ORDER BY c_custkey) + top AS r, CASE WHEN even THEN c_mktsegment NOT LIKE 'MACH%' ELSE c_mktsegment LIKE '%ING' OR c_mktsegment LIKE '%MOBILE%' END AS scope FROM c)
"""
ORACLE_SQL = {
    "header_detect": _ROWS + "SELECT DISTINCT 'f.xlsx' AS source_file, sheet, top AS header_row, CASE WHEN low THEN 10 ELSE 12 END AS score FROM s",
    "sections": _ROWS + 'SELECT sheet, h AS header_row, count(*) AS "rows" FROM s WHERE NOT again GROUP BY 1, 2',
    "normalize_cells": _ROWS + "SELECT sheet, r AS source_row, 'order ' || o_orderkey AS title, CAST(o_custkey AS VARCHAR) AS author, '' AS external_id, CASE WHEN NOT low THEN round(o_totalprice) END AS sale_amount FROM s WHERE NOT again AND NOT contains('order ' || o_orderkey, '0000')",
    "sheet_audit": _ROWS + "SELECT 'f.xlsx' AS source_file, sheet, count(*) + any_value(top) AS sheet_rows, count(*) AS data_rows, count(*) FILTER (again OR low) AS bad_sale, CASE WHEN count(*) FILTER (again OR low) > 0 THEN 'sales that are no numbers' ELSE '' END AS messages FROM s GROUP BY sheet",
    "platform_audit": _BOOKS + """, s AS (SELECT f, c_mktsegment AS g, even, scope AND n_name <> 'NATION_7' AS ok, regexp_matches(f, '_[13579][.]') AS torn, count(*) AS n FROM b GROUP BY ALL),
w AS (SELECT f, string_agg('header_not_found: ' || g, ' | ' ORDER BY g) FILTER (k <= 3) AS c FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY g) AS k FROM s WHERE ok AND torn) GROUP BY f),
y AS (SELECT string_agg('header_not_found: ' || f || ' ' || c, ' | ' ORDER BY f || ' ' || c) FILTER (k <= 3) AS c FROM (SELECT *, row_number() OVER (ORDER BY f || ' ' || c) AS k FROM w)),
t AS (SELECT CASE WHEN even THEN 'even' ELSE 'odd' END AS platform, count(DISTINCT f) AS files, coalesce(sum(n) FILTER (ok AND NOT torn), 0) AS r FROM s GROUP BY 1)
SELECT platform, files, CAST(r AS BIGINT) AS parsed_rows, CAST(r AS BIGINT) AS feed_rows, 'materialized_default_feed' AS materialisation, CASE platform WHEN 'even' THEN 's2_projection_candidate_after_policy' ELSE 's2_projection_blocked_by_amount_or_policy' END AS projection,
 'pass_after_substitution' AS "check", CAST(r AS BIGINT) AS checked, CAST(r AS BIGINT) AS matched, CASE platform WHEN 'odd' THEN (SELECT c FROM y) ELSE '' END AS causes FROM t
 UNION ALL SELECT 'spare', 0, 0, 0, 'no_period_source', 's2_projection_blocked_non_s2_source', 'skipped_no_default_feed', 0, 0, ''""",
    "workbook_sheet": _BOOKS + """SELECT f AS file, r AS "row", CAST(c_custkey AS VARCHAR) AS code, '[연재] ' || c_name AS title, format('{:,.2f}', c_acctbal) AS sale FROM b WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT DISTINCT f, 1, 'Sales', NULL, NULL FROM b WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT DISTINCT f, top, 'Ｃｏｄｅ', 'Ti-tle', 'Sale (KRW)' FROM b WHERE c_mktsegment = 'BUILDING'
 UNION ALL SELECT f, max(r) + 1, NULL, 'total', CAST(max(r) AS VARCHAR) FROM b WHERE c_mktsegment = 'BUILDING' GROUP BY f""",
    "normalize_workbooks": _BOOKS + """SELECT CASE WHEN even THEN 'even' ELSE 'odd' END AS platform, f AS source_file, c_mktsegment AS sheet, r AS source_row, 'include' AS file_status, 'parsed' AS row_status, '[연재] ' || c_name AS title,
 CASE WHEN even THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS external_id, format('{:,.2f}', c_acctbal) AS sale, 'customer' AS clean_key, CASE WHEN even THEN 'single_header' ELSE 'multi_section_repeated_header_parser' END AS parser_contract,
 CASE WHEN even THEN 'locked' ELSE 'candidate' END AS amount_rule_status, CASE WHEN even THEN 'open' ELSE 'closed' END AS s2_gate FROM b WHERE scope AND n_name <> 'NATION_7'""",
    "workbook_audit": _BOOKS + """SELECT f AS source_file, c_mktsegment AS sheet, CASE WHEN even THEN 'even' ELSE 'odd' END AS platform, CASE WHEN n_name = 'NATION_7' THEN 'excluded_by_rule' WHEN NOT scope THEN 'excluded_sheet' ELSE 'parsed' END AS status,
 CASE WHEN scope AND n_name <> 'NATION_7' THEN top END AS header_row, count(*) FILTER (scope AND n_name <> 'NATION_7') AS parsed_rows, count(*) FILTER (scope AND n_name <> 'NATION_7') AS titled_rows FROM b GROUP BY ALL""",
}
