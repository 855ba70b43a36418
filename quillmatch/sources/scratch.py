"""A folder for tables and files that one query writes and reads again."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, kind: str) -> str:
    """A new path below the folder that the session names in spark.checkpoint.dir (ValueError if that is unset, but for sessions of one machine, which
    take a temporary folder). It is scratch space: its owner clears it."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        shared = held.get() if held.isDefined() else None
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        shared = os.path.join(tempfile.gettempdir(), "quillmatch-scratch")
    return f"{shared.rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def landed(df: DataFrame) -> DataFrame:
    """df written once as a table and read: for what is dear to make and read several times, such as the cells of workbooks. A lost executor costs a task
    of the write at most."""
    path = folder(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out over the session's tasks where its scan has fewer (a small file is one task, however much is made of its rows)."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def dealt(df: DataFrame, keys: Sequence[str], each: int = 100_000) -> DataFrame:
    """df dealt out by keys, about `each` rows a task however many there are (but over all of the session's tasks): what a task sorts then doesn't grow with
    the table. df is counted for it, so it should be cheap to read."""
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // each))
    return df.repartition(tasks, *keys)
