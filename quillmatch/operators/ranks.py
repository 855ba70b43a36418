"""Places in an order over all rows, without all rows in one task; ordered parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmatch.sources.scratch import landed

#: Ranges whose counts are taken as a literal of the plan; beyond, they are joined.
LITERAL = 1 << 12
PART_ROWS = 75_000


def global_rank(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """df with out, each row's place from 1 in the order. The order must tell rows apart; equal ones are placed in any way.

    Two passes: rows are dealt out by ranges of the order and kept as a table with the number of their range; each range is counted, and a
    row's place is its place within its range, after the rows of the ranges before it. One count for each range comes to the driver.
    """
    part = _free(df, "part")
    held = landed(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    before, total = [], 0
    for p, n in sorted(tuple(r) for r in held.groupBy(part).count().collect()):
        before.append((p, total))
        total += n
    place = held.withColumn(out, F.row_number().over(Window.partitionBy(part).orderBy(*order)).cast("long"))
    if not before:
        return place.drop(part)
    if len(before) <= LITERAL:
        offset = F.element_at(F.create_map(*(F.lit(x) for row in before for x in row)), F.col(part))
        return place.withColumn(out, F.col(out) + offset).drop(part)
    first = _free(place, "first")
    table = df.sparkSession.createDataFrame(before, f"{part} int, {first} long")
    return place.join(F.broadcast(table), part).withColumn(out, F.col(out) + F.col(first)).drop(part, first)  # a row a range


def _free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name = f"_{name}"
    return name


def numbered_parts(df: DataFrame, order: Sequence[Column], rows: int = PART_ROWS) -> DataFrame:
    """df in order with file_no and row_no from 1: `rows` rows a file."""
    ranked = global_rank(df, order, "row_no")
    return ranked.select(*df.columns, (F.floor((F.col("row_no") - 1) / rows) + 1).alias("file_no"), ((F.col("row_no") - 1) % rows + 1).alias("row_no"))


def write_ordered(df: DataFrame, order: Sequence[Column], path: str, rows: int = PART_ROWS) -> None:
    """CSV in parts of `rows` rows: one file in each folder file_no=1, 2, ...; read one after another they give df in its order. Old parts are replaced."""
    parts = numbered_parts(df, order, rows)
    parts.repartition("file_no").sortWithinPartitions("file_no", "row_no").write.mode("overwrite").partitionBy("file_no").option("escape", '"').csv(path, header=True)


def read_ordered(spark: SparkSession, path: str) -> DataFrame:
    """What write_ordered() wrote, as text, with file_no and row_no as numbers: the order is that of (file_no, row_no)."""
    out = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return out.withColumns({c: F.col(c).cast("long") for c in ("file_no", "row_no")})
