"""Irregular sheets to one statement schema.

A sheet is a relation of cells (source_file, sheet, row, col, value); all files are one relation and every step partitions by sheet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions.text import field_candidates, nfkc, norm_header, parse_amount, text
from quillmatch.functions.titles import add_clean_key

SHEET = ["source_file", "sheet"]
#: Weight of a field's header in a header row's score; a row without a title header scores 0.
WEIGHTS = {"title": 8, "author": 2, "external_id": 1, "sale": 2, "base": 2, "offset": 1}
HEADER_ROWS = 100
LEAST_SCORE = 8


def fill_merged(cells: DataFrame, merges: DataFrame) -> DataFrame:
    """Blank cells inside a merged range (source_file, sheet, min_row, min_col, max_row, max_col) take its top left value."""
    top = cells.select(*SHEET, F.col("row").alias("min_row"), F.col("col").alias("min_col"), text("value").alias("filled"))
    spread = merges.join(top, [*SHEET, "min_row", "min_col"]).where("filled <> ''")
    spread = spread.withColumn("row", F.explode(F.sequence("min_row", "max_row"))).withColumn("col", F.explode(F.sequence("min_col", "max_col")))
    both = cells.join(spread.select(*SHEET, "row", "col", "filled"), [*SHEET, "row", "col"], "full_outer")
    return both.select(*SHEET, "row", "col", F.when(text("value") != "", F.col("value")).otherwise(F.coalesce("filled", "value")).alias("value"))


def header_key(c: Column | str) -> Column:
    """A header in the form in which headers are compared: NFKC, then norm_header()."""
    return norm_header(nfkc(text(c)))


def add_header_key(df: DataFrame, c: str, out: str) -> DataFrame:
    """df with header_key(c), in steps of their own so that each is made once a cell."""
    return df.withColumn("_t", text(c)).withColumn("_t", nfkc("_t")).withColumn(out, norm_header("_t")).drop("_t")


def _by(candidates: DataFrame) -> list[str]:
    return ["platform"] if "platform" in candidates.columns else []


def _score(fields: Column) -> Column:
    """The score of a row by the fields that its cells name, a bit each in the order of WEIGHTS; null without a title header."""
    named = lambda f: fields.bitwiseAND(1 << list(WEIGHTS).index(f)) != 0
    return F.when(named("title"), reduce(add, (F.when(named(f), w).otherwise(0) for f, w in WEIGHTS.items())))


def header_scores(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """Score of every row that has a title header. candidates(field, header, pos): the names under which a field is known; with a platform there,
    a sheet's cells have one too, and only its platform's names count."""
    by = _by(candidates)
    bit = F.coalesce(*(F.when(F.col("field") == f, 1 << i) for i, f in enumerate(WEIGHTS)), F.lit(0))
    known = candidates.select(*by, header_key("header").alias("h"), bit.alias("_bit")).groupBy(*by, "h").agg(F.bit_or("_bit").alias("_bit"))
    hit = add_header_key(cells.select(*SHEET, *by, "row", "value"), "value", "h").join(known, [*by, "h"]).where(text("value") != "")
    return hit.groupBy(*SHEET, "row").agg(_score(F.bit_or("_bit")).cast("long").alias("score")).where("score is not null")


def find_header(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """The header row of each sheet: the best score among the first HEADER_ROWS rows, the first on ties."""
    w = Window.partitionBy(*SHEET).orderBy(F.desc("score"), "row")
    scored = header_scores(cells.where(F.col("row") <= HEADER_ROWS), candidates).where(F.col("score") >= LEAST_SCORE)
    return scored.withColumn("n", F.row_number().over(w)).where("n = 1").select(*SHEET, F.col("row").alias("header_row"), "score")


def _headed(cells: DataFrame, candidates: DataFrame, fields: Sequence[str] = (), repeated: bool = True) -> DataFrame:
    """cells below a header, with _head: the row of the header that applies and, for each of fields, the column that it names (_0, _1, ...; null if none).

    repeated: every headed row begins a section, else the best row among the first HEADER_ROWS is the sheet's header (the first on ties). Cells move once, to
    the task of their sheet, and are sorted once, by row; cells that a caller has dealt out by SHEET don't move at all.
    """
    by = _by(candidates)
    names = list(dict.fromkeys([*WEIGHTS, *fields]))
    place = [F.min(F.when(F.col("field") == f, F.col("pos").cast("long"))).alias(f"_{i}") for i, f in enumerate(names)]
    known = candidates.withColumn("_h", header_key("header")).groupBy(*by, "_h").agg(*place).select(*by, "_h", F.struct(*(f"_{i}" for i in range(len(names)))).alias("_hit"))
    rows = add_header_key(cells.where(" and ".join(f"{c} is not null" for c in (*SHEET, "row", "col"))), "value", "_h").join(known, [*by, "_h"], "left")
    sheet = Window.partitionBy(*SHEET)
    row = sheet.orderBy("row").rangeBetween(Window.currentRow, Window.currentRow)
    bits = reduce(add, (F.when(F.col(f"_hit._{i}").isNotNull(), 1 << i).otherwise(0) for i in range(len(WEIGHTS))))
    score = _score(F.bit_or(F.when(F.col("_hit").isNotNull() & (text("value") != ""), bits)).over(row))
    first = [F.min(F.shiftleft(F.col(f"_hit._{names.index(f)}"), 32) + F.col("col")).over(row).alias(f"_{i}") for i, f in enumerate(fields)]  # by place, then column
    rows = rows.select(*cells.columns, score.alias("_score"), *first)
    found = F.struct(F.col("row").alias("row"), *(F.col(f"_{i}").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias(f"_{i}") for i in range(len(fields))))
    if repeated:
        head = F.last(F.when(F.col("_score") >= LEAST_SCORE, found), ignorenulls=True).over(sheet.orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    else:
        best = F.when((F.col("_score") >= LEAST_SCORE) & (F.col("row") <= HEADER_ROWS), F.struct(-F.col("_score"), F.col("row"), found.alias("head")))
        head = F.min(best).over(sheet)["head"]
    return rows.select(*cells.columns, head.alias("_head")).where("row > _head.row")


def sections(cells: DataFrame, candidates: DataFrame) -> DataFrame:
    """cells below a header row, with the row of the header that applies: each headed row begins a section."""
    others = [c for c in cells.columns if c not in (*SHEET, "row")]
    return _headed(cells, candidates).select(*SHEET, "row", *others, F.col("_head.row").alias("header_row"))


def unique_headers(headers: DataFrame) -> DataFrame:
    """headers(source_file, sheet, col, value) -> name: blanks become column_<col>, repeats get __2, __3."""
    name = F.when(text("value") == "", F.concat(F.lit("column_"), F.col("col").cast("string"))).otherwise(text("value"))
    n = F.row_number().over(Window.partitionBy(*SHEET, "_h").orderBy("col"))
    return headers.withColumn("_h", name).withColumn("name", F.when(n == 1, F.col("_h")).otherwise(F.concat("_h", F.lit("__"), n.cast("string")))).drop("_h")


def standardize(cells: DataFrame, candidates: DataFrame, fields: Sequence[str] = ("title", "author", "external_id", "sale", "base", "offset"), repeated: bool = False) -> DataFrame:
    """One row a data row: source_file, sheet, source_row and the fields ("" if absent).

    A field takes the first of its candidate names that the header has, and of equal headers the leftmost column. repeated: sheets of
    several sections, else one header row.
    """
    body = _headed(cells, candidates, fields, repeated)
    mine = [F.col("col") == F.col(f"_head._{i}") for i in range(len(fields))]
    wide = body.where(reduce(or_, (F.coalesce(m, F.lit(False)) for m in mine))).groupBy(*SHEET, "row").agg(*(F.max(F.when(m, F.col("value"))).alias(f) for m, f in zip(mine, fields, strict=True)))
    return wide.select(*SHEET, F.col("row").alias("source_row"), *(text(f).alias(f) for f in fields))


def drop_non_data(rows: DataFrame, exact: Sequence[str], markers: Sequence[str], title: str = "title") -> DataFrame:
    """Rows whose title is data: not blank, not a header or total word, without a marker."""
    t = text(title)
    out = rows.where((t != "") & ~t.isin(list(exact)))
    for m in markers:
        out = out.where(~F.contains(t, F.lit(m)))
    return out


def repair_titles(rows: DataFrame, rules: DataFrame, on: Sequence[str], title: str = "title") -> DataFrame:
    """Titles that a spreadsheet turned into something else, put right by rules(*on, repaired), a table of a few rows."""
    return rows.join(rules, list(on), "left").withColumn(title, F.coalesce("repaired", title)).drop("repaired")


def feed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of files(source_file, file_status) that are included; amounts are parsed, their text stays beside them; source_row stays."""
    out = rows.join(files.where("file_status = 'include'").select("source_file"), "source_file", "left_semi")
    return out.withColumns({f"{a}_amount": parse_amount(a) for a in ("sale", "base", "offset") if a in rows.columns})


def audit(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Per sheet: rows of cells, data rows, rows without a number in sale, and messages."""
    seen = cells.groupBy(*SHEET).agg(F.count_distinct("row").alias("sheet_rows"))
    made = rows.groupBy(*SHEET).agg(F.count("*").alias("data_rows"), F.sum(F.when(parse_amount("sale").isNull(), 1).otherwise(0)).cast("long").alias("bad_sale"))
    out = seen.join(made, SHEET, "left").na.fill(0)
    messages = F.array_compact(F.array(F.when(F.col("data_rows") == 0, "no data rows"), F.when(F.col("bad_sale") > 0, "sales that are no numbers")))
    return out.withColumn("messages", F.array_join(messages, " | "))


def registry_candidates(registry: DataFrame) -> DataFrame:
    """registry(platform, <field>_from, ...), the adapters' rules as text -> candidates(platform, field, header, pos)."""
    each = [F.struct(F.lit(f).alias("field"), field_candidates(f"{f}_from").alias("headers")) for f in WEIGHTS if f"{f}_from" in registry.columns]
    rules = registry.select("platform", F.explode(F.array(*each)).alias("x")).select("platform", "x.field", F.posexplode("x.headers").alias("pos", "header"))
    return rules.groupBy("platform", "field", "header").agg(F.min("pos").alias("pos"))


def statement_rows(rows: DataFrame, files: DataFrame, registry: DataFrame) -> DataFrame:
    """standardize()'s rows in the statement schema of 16 columns: files(source_file, platform, file_status) and the adapter's policy beside them."""
    policy = registry.groupBy("platform").agg(*(F.min(c).alias(c) for c in ("parser_contract", "amount_rule_status", "s2_gate")))
    out = rows.join(files.select("source_file", "platform", "file_status"), "source_file").join(policy, "platform", "left")
    status = F.when(text("title") == "", "no_title").when(parse_amount("sale").isNull(), "no_amount").otherwise("parsed")
    out = add_clean_key(out.withColumn("row_status", status), "title")
    return out.select("platform", "source_file", "sheet", "source_row", "file_status", "row_status", "title", "author", "external_id", "sale", "base", "offset", "clean_key", "parser_contract", "amount_rule_status", "s2_gate")


#: The contract of adapters whose sheets hold several sections, each with a header of its own.
REPEATED = "multi_section_repeated_header_parser"


def in_scope(sheets: DataFrame, scope: DataFrame) -> DataFrame:
    """sheets(platform, sheet, ...) with in_scope: scope(platform, wanted, unwanted) has regular expressions for names of sheets, a null counts as none. A
    sheet needs one of its platform's wanted ones, if there are any, and none of the unwanted ones; platforms without rules take all."""
    said = sheets.select("platform", "sheet").distinct().join(scope, "platform", "left")
    hit = lambda c: F.coalesce(F.max(F.expr(f"sheet rlike {c}")), F.lit(False))
    judged = said.groupBy("platform", F.col("sheet").alias("_s")).agg((((F.count("wanted") == 0) | hit("wanted")) & ~hit("unwanted")).alias("in_scope"))
    judged = judged.withColumnRenamed("platform", "_p")
    return sheets.join(judged, (F.col("platform") == F.col("_p")) & F.col("sheet").eqNullSafe(F.col("_s"))).drop("_p", "_s")  # no sheet: a broken file


def normalize_statements(
    cells: DataFrame, merges: DataFrame, files: DataFrame, registry: DataFrame, scope: DataFrame, blocked: DataFrame | None = None, totals: DataFrame | None = None,
    repairs: tuple[DataFrame, Sequence[str]] | None = None, exact: Sequence[str] = (), markers: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Workbooks to statement rows, and an audit of every sheet.

    cells and merges as io.split_merges() gives them, errors included; files(source_file, platform, file_status); registry: the adapters, see
    registry_candidates(); scope: see in_scope(); blocked, totals, repairs (rules and their columns): see drop_blocked_columns(),
    drop_platform_totals(), repair_titles(). Files excluded by rule aren't parsed; merged cells are filled; adapters of REPEATED find a header for each section.

    The audit has status (excluded_by_rule, excluded_sheet, unreadable, header_not_found, no_data, parsed), header_row (the first), parsed_rows and titled_rows.
    A file without an adapter has none of its sheets parsed: no header is known to it.
    """
    known = files.select("source_file", "platform", "file_status")
    broken = cells.where("value_type = 'error'").select(F.col("source_file").alias("_file"), F.col("sheet").alias("_sheet")).distinct()
    sheets = in_scope(cells.select(*SHEET).distinct().join(known, "source_file"), scope)
    open_ = sheets.where("in_scope and file_status <> 'excluded_by_rule'").select(*SHEET, "platform")
    filled = fill_merged(cells.where("value_type <> 'error'").select(*SHEET, "row", "col", "value"), merges).join(open_, SHEET)
    names = registry_candidates(registry)
    if blocked is not None:
        filled = drop_blocked_columns(filled, find_header(filled, names), blocked)
    several = registry.where(F.col("parser_contract") == REPEATED).select("platform").distinct()
    rows = standardize(filled.join(several, "platform", "left_anti"), names).unionByName(standardize(filled.join(several, "platform", "left_semi"), names, repeated=True))
    rows = drop_non_data(rows.join(open_, SHEET), exact, markers)
    if totals is not None:
        rows = drop_platform_totals(rows, totals)
    if repairs is not None:
        rows = repair_titles(rows, *repairs)
    out = statement_rows(rows.drop("platform"), files, registry)
    made = out.groupBy(*SHEET).agg(F.count("*").alias("parsed_rows"), F.sum((text("title") != "").cast("long")).alias("titled_rows"))
    heads = header_scores(filled, names).where(F.col("score") >= LEAST_SCORE).groupBy(*SHEET).agg(F.min("row").alias("header_row"))
    audit = sheets.join(heads, SHEET, "left").join(made, SHEET, "left")
    audit = audit.join(broken, (F.col("source_file") == F.col("_file")) & F.col("sheet").eqNullSafe(F.col("_sheet")), "left")
    status = (
        F.when(F.col("file_status") == "excluded_by_rule", "excluded_by_rule").when(~F.col("in_scope"), "excluded_sheet").when(F.col("_file").isNotNull(), "unreadable")
        .when(F.col("header_row").isNull(), "header_not_found").when(F.col("parsed_rows").isNull(), "no_data").otherwise("parsed")
    )
    return out, audit.select(*SHEET, "platform", status.alias("status"), "header_row", F.coalesce("parsed_rows", F.lit(0)).alias("parsed_rows"), F.coalesce("titled_rows", F.lit(0)).alias("titled_rows"))


def drop_blocked_columns(cells: DataFrame, header_row: DataFrame, blocked: DataFrame) -> DataFrame:
    """cells (with a platform) without the columns whose header holds a word of blocked(platform, word); header_row: find_header's.

    Headers come to one row a column before the words are joined by platform, and the columns that go to one row a sheet, so cells aren't multiplied and
    don't move where they are dealt out by SHEET.
    """
    heads = cells.join(header_row.select(*SHEET, "header_row"), SHEET).where("row - header_row = 0")  # no equality: cells would move by row, too
    heads = heads.select(*SHEET, "platform", "col", header_key("value").alias("h"))
    words = blocked.select("platform", header_key("word").alias("w")).where("w <> ''")
    gone = heads.join(words, "platform").where(F.contains("h", "w")).groupBy(*SHEET).agg(F.collect_set("col").alias("_gone"))
    return cells.join(gone, SHEET, "left").where(~F.coalesce(F.array_contains("_gone", F.col("col")), F.lit(False))).select(*SHEET, *(c for c in cells.columns if c not in SHEET))


def drop_platform_totals(rows: DataFrame, rules: DataFrame, title: str = "title") -> DataFrame:
    """rows without titles that begin and end as rules(platform, prefix, suffix) says: totals that look like titles."""
    known = rules.groupBy(F.col("platform").alias("_p")).agg(F.collect_list(F.struct("prefix", "suffix")).alias("_rules"))
    t = text(title)
    hit = F.exists("_rules", lambda r: F.startswith(t, r["prefix"]) & F.endswith(t, r["suffix"]))
    return rows.join(known, F.col("platform") == F.col("_p"), "left").where(~F.coalesce(hit, F.lit(False))).select(*rows.columns)


def row_numbers(rows: DataFrame, file: str, order: Sequence[str], out: str = "row_no") -> DataFrame:
    """Rows numbered from 1 within each file."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(file).orderBy(*order)))


def legacy_rows(cells: DataFrame, id_headers: Sequence[str], preferred: str = "Sheet1") -> DataFrame:
    """Cells of the rows that carry a mapped id, of the preferred sheet of each file or else its first by name, with their header; row 1 is the header.

    A file whose sheet has none of id_headers keeps all its rows.
    """
    sheets = cells.groupBy("source_file").agg(F.coalesce(F.max(F.when(F.col("sheet") == preferred, preferred)), F.min("sheet")).alias("sheet"))
    mine = cells.join(sheets, SHEET)
    heads = mine.where("row = 1").select(*SHEET, "col", F.when(text("value") == "", F.concat(F.lit("column_"), F.col("col").cast("string"))).otherwise(text("value")).alias("header"))
    ids = heads.where(F.col("header").isin(list(id_headers))).groupBy(*SHEET).agg(F.min_by("col", F.struct(F.array_position(F.array(*map(F.lit, id_headers)), F.col("header")).alias("p"), "col")).alias("_id"))
    body = mine.where("row > 1").join(ids, SHEET, "left")
    filled = body.where((F.col("col") == F.col("_id")) & ~text("value").isin("", "None", "nan")).select(*SHEET, "row")
    kept = body.where("_id is null").select(*SHEET, "row").distinct().unionByName(filled)
    return mine.join(kept, [*SHEET, "row"], "left_semi").join(heads, [*SHEET, "col"]).select(*SHEET, "row", "col", "header", "value")
