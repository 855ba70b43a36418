"""Reading landed files and writing results."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmatch.functions.text import col, text
from quillmatch.operators.linkage import summary_counts
from quillmatch.sources.versions import _hadoop
from quillmatch.sources.workbooks import BROKEN, CELLS, shared_strings, sheet_cells, sheet_parts



def _there(spark: SparkSession, path: str) -> bool:
    files, make = _hadoop(spark, path)
    return len(files.globStatus(make(path)) or []) > 0


def scan_lookup(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """CSV as text, exactly these columns: absent ones are "", cells may span lines. Paths may be patterns; no path, or none of them there: no rows."""
    paths = [p for p in ([paths] if isinstance(paths, str) else paths) if _there(spark, p)]
    if not paths:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in columns]))
    df = spark.read.csv(paths, header=True, multiLine=True, escape='"', inferSchema=False)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns))


def scan_parts(spark: SparkSession, folder: str, stem: str, columns: Sequence[str]) -> DataFrame:
    """A table that was landed in parts, <stem>_part_*.csv, or else in one file, <stem>.csv; no rows if neither is there."""
    parts = f"{folder}/{stem}_part_*.csv"
    return scan_lookup(spark, parts if _there(spark, parts) else f"{folder}/{stem}.csv", columns)


#: Columns that tell the interface's own layout of payment rows.
RAW_MARKERS = ("schnCtnsId", "ctnsId", "ctnsNm", "pymtSetlId", "pymtSetlDtlId")


def payment_rows(df: DataFrame, names: dict[str, str], required: Sequence[str]) -> DataFrame:
    """Payment rows in the standard layout: as they are if they have the required columns; with raw names (names: raw -> standard) made standard ones if the
    columns of RAW_MARKERS are there, where a standard column that is there already is kept. ValueError that lists what is missing."""
    if all(c in df.columns for c in required):
        return df
    out = df
    if all(c in df.columns for c in RAW_MARKERS):
        out = df.withColumns({new: F.col(old) for old, new in names.items() if old in df.columns and new not in df.columns})
    absent = [c for c in required if c not in out.columns]
    if absent:
        raise ValueError("the payment rows lack columns: " + ", ".join(absent))
    return out


def payment_from_json(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Raw names to standard ones as text; a standard column that is there already is kept."""
    out = [F.coalesce(*(F.col(c).cast("string") for c in (new, old) if c in df.columns), F.lit("")).alias(new) for old, new in names.items()]
    return df.select(*out)


def _read_workbook(data: bytes) -> Iterator[tuple]:
    """(sheet, row, col, value, type) of every cell, and (sheet, min row, min col, 'max row,max col', 'merge')."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = shared_strings(z)
        for sheet, part in sheet_parts(z).items():
            for cell in sheet_cells(z, part, shared):
                yield sheet, *cell


def scan_workbooks(spark: SparkSession, path: str, glob: str = "*.xlsx") -> tuple[DataFrame, DataFrame]:
    """cells and merges of all workbooks below path; a file that can't be read gives one row with its error. A workbook is read in one task: read_workbooks() has a
    task for each sheet, this one reaches whatever Spark's readers reach."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                rows = []
                try:
                    for cell in _read_workbook(data):
                        rows.append((name, *cell, None))
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=[x.split()[0] for x in CELLS.split(", ")])
                            rows = []
                except BROKEN as e:
                    rows.append((name, None, 0, 0, None, "error", f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in CELLS.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return split_merges(files.select("path", "content").mapInPandas(run, CELLS))


def split_merges(every: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a scan of workbooks gives as cells (errors too) and merged ranges."""
    ends = F.split("value", ",")
    merges = every.where("value_type = 'merge'").select("source_file", "sheet", F.col("row").alias("min_row"), F.col("col").alias("min_col"), ends[0].cast("int").alias("max_row"), ends[1].cast("int").alias("max_col"))
    return every.where("value_type <> 'merge'"), merges


def sheet_table(cells: DataFrame, sheet: str | None = None) -> DataFrame:
    """Cells by row as a map of column to value, of one sheet or of all with their sheet."""
    rows = cells.where(F.col("value_type") != "error")
    rows = rows if sheet is None else rows.where(F.col("sheet") == sheet)
    return rows.groupBy("source_file", "sheet", "row").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("col", "value")))).alias("cells"))


def period(path: Column | str, year: int | None = None) -> Column:
    """YYYY-MM from a path: 2026-02, 202602, 2026년 2월, or with year a month alone; "" if none."""
    p = col(path)
    both = [F.regexp_extract(p, r, g) for r in (r"(20\d{2})[-_. ]?(0[1-9]|1[0-2])(?!\d)", r"(20\d{2})년\s*(\d{1,2})월") for g in (1, 2)]
    made = [F.when(both[i] != "", F.concat(both[i], F.lit("-"), F.lpad(both[i + 1], 2, "0"))) for i in (0, 2)]
    month = F.regexp_extract(p, r"(?<!\d)(\d{1,2})월", 1)
    alone = F.when(month != "", F.concat(F.lit(f"{year}-"), F.lpad(month, 2, "0"))) if year else F.lit(None).cast("string")
    return F.coalesce(*made, alone, F.lit(""))


def latest_snapshot(paths: DataFrame, path: str = "path", modified: str = "modified") -> DataFrame:
    """The path of the latest dated folder (eight digits), the latest modified on ties, and its date."""
    day = F.regexp_extract(path, r"/(20\d{6})(?:/|$)", 1)
    dated = paths.withColumn("_d", day).where("_d <> ''")
    return dated.agg(F.max_by(path, F.struct("_d", modified)).alias("path"), F.try_to_date(F.max("_d"), "yyyyMMdd").alias("as_of"))


def write_csv(df: DataFrame, path: str, max_rows: int = 75_000) -> None:
    df.write.mode("overwrite").option("maxRecordsPerFile", max_rows).option("escape", '"').csv(path, header=True)


def write_by_class(df: DataFrame, column: str, path: str) -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def append_run(df: DataFrame, path: str, statuses: Sequence[str] = ("success", "failed", "running")) -> None:
    """Appends to the run log; a status that isn't known becomes failed."""
    status = text("status")
    df.withColumn("status", F.when(status.isin(list(statuses)), status).otherwise("failed")).write.mode("append").parquet(path)


def append_changes(changes: DataFrame, path: str, run_id: Column, kinds: Sequence[str] = ("added", "deleted", "modified")) -> None:
    """Appends the changes of a run to the log; kinds of change that aren't known are dropped."""
    changes.where(text("change").isin(list(kinds))).withColumn("run_id", run_id).write.mode("append").parquet(path)


def write_mapping(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of one mapping run, each in a folder of its own."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_mapping_run(rows: DataFrame, dup: DataFrame, validation: DataFrame, path: str) -> DataFrame:
    """A mapping run's five tables: rows, review, duplicates, validation and summary (item, value), which is returned.

    The mapped rows are made once: what the summary counts is observed while they are written, and the rows to review are read from
    what was written.
    """
    spark = rows.sparkSession
    counters = summary_counts()
    seen = Observation()
    rows.observe(seen, *(c.alias(f"c{i}") for i, c in enumerate(counters.values()))).write.mode("overwrite").parquet(f"{path}/rows")
    dup.write.mode("overwrite").parquet(f"{path}/duplicates")
    got = seen.get
    items = [(name, int(got[f"c{i}"] or 0)) for i, name in enumerate(counters)]
    items.append(("duplicate keys", spark.read.parquet(f"{path}/duplicates").count()))
    spark.createDataFrame(items, "item string, value long").coalesce(1).write.mode("overwrite").parquet(f"{path}/summary")
    spark.read.parquet(f"{path}/rows").where("review = 'Y'").write.mode("overwrite").parquet(f"{path}/review")
    validation.write.mode("overwrite").parquet(f"{path}/validation")
    return spark.read.parquet(f"{path}/summary")


def write_reports(df: DataFrame, by: str, path: str) -> None:
    """The reports of all channels, a partition of the folder each; what was there goes."""
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(path)


def rewrite_reports(df: DataFrame, touched: DataFrame, by: str, path: str, lineage: DataFrame | None = None) -> None:
    """Replaces the reports of the touched channels (touched has the column by) and leaves the files of the others as they are.

    Partitions that df has are overwritten dynamically; one that is touched and has no rows any more is removed. lineage: rows that tell
    which additions touched which channel, appended to <path>-lineage.
    """
    spark = df.sparkSession
    held = df.join(touched.select(by).distinct(), by, "left_semi")
    held.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    emptied = touched.select(by).distinct().join(spark.read.parquet(path).select(by).distinct(), by).join(held.select(by).distinct(), by, "left_anti")
    gone = {row[0] for row in emptied.collect()}  # channels that have lost all their rows
    files, make = _hadoop(spark, path)
    for status in files.listStatus(make(path)) if gone else ():
        name, _, value = status.getPath().getName().partition("=")
        if name == by and unquote(value) in gone:
            files.delete(status.getPath(), True)
    if lineage is not None:
        lineage.write.mode("append").parquet(f"{path}-lineage")


def load_payment(tables: Sequence[DataFrame], required: Sequence[str], names: dict[str, str]) -> DataFrame:
    """The first table that has the required columns, or has them once raw names are made standard ones; tables come in order of preference."""
    for df in tables:
        for made in (df, df.withColumnsRenamed({old: new for new, old in names.items() if old in df.columns and new not in df.columns})):
            if all(c in made.columns for c in required):
                return made
    absent = [c for c in required if not tables or c not in tables[0].columns]
    raise ValueError("the payment source lacks columns: " + ", ".join(absent))


def discover(files: DataFrame, keyword: str, month: str, path: str = "path", year: int | None = None) -> DataFrame:
    """Paths whose file name holds keyword and whose path tells the period month (YYYY-MM)."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return files.withColumn("period", period(path, year)).where(F.contains(name, F.lit(keyword)) & (F.col("period") == month))
