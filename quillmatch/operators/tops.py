"""The most frequent values of many columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmatch.functions.text import text

BLANK = "(blank)"


def top_values(df: DataFrame, columns: Sequence[str], limit: int = 20, tracked: int = 4096) -> DataFrame:
    """column, value, n, place: the `limit` most frequent values of each of columns (blank ones as "(blank)"), ties by value.

    Scan 1 keeps a sketch of frequent values for each column (`tracked` of them, merged across tasks) and takes the likeliest 2 * limit as
    candidates, of which there are few whatever the table. Scan 2 counts them exactly. The sketch never tells too little of a value it
    tracks, and whatever it left out occurs at most as often as it says of the last candidate: if the exact count in place `limit` is higher
    than that, or if the candidates are all values that there are, none is missing. Columns without that proof (flat ones, as ids are) are
    counted whole.
    """
    wanted = min(2 * limit, tracked)
    value = lambda c: F.when(text(c) == "", BLANK).otherwise(text(c))
    sketches = [F.expr(f"approx_top_k({name}, {wanted}, {tracked})").alias(name) for name in (f"v{i}" for i in range(len(columns)))]
    found = df.select(*(value(c).alias(f"v{i}") for i, c in enumerate(columns))).agg(F.count("*").alias("rows"), *sketches).first()
    candidates = [(c, x[0], x[1], len(found[f"v{i}"])) for i, c in enumerate(columns) for x in found[f"v{i}"]]
    spark = df.sparkSession
    known = spark.createDataFrame(candidates, "column string, value string, said long, many int")
    bounds = known.groupBy("column").agg(F.min("said").alias("bound"))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), value(c).alias("value")) for c in columns))).alias("x")).select("x.*")
    counted = long.join(F.broadcast(known.select("column", "value")), ["column", "value"]).groupBy("column", "value").agg(F.count("*").alias("n"))
    placed = counted.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value")))
    shown = {(r["column"], r["place"]): r for r in placed.join(bounds, "column").collect()}  # 2 * limit rows a column at most
    sure, rest = [], []
    for c in columns:
        rows = [r for (name, _), r in shown.items() if name == c]
        last = next((r for r in rows if r["place"] == limit), None)
        if sum(r["n"] for r in rows) == found["rows"] or (last is not None and last["n"] > last["bound"]):
            sure += [(c, r["value"], r["n"], r["place"]) for r in rows if r["place"] <= limit]
        else:
            rest.append(c)
    out = spark.createDataFrame(sure, "column string, value string, n long, place int")
    if rest:
        whole = long.where(F.col("column").isin(rest)).groupBy("column", "value").agg(F.count("*").alias("n"))
        ranked = whole.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("place") <= limit)
        out = out.unionByName(ranked)
    return out
