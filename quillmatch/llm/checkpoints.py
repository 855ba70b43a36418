"""Cutting lineage in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


#: Rows of a few numbers that a task writes, where it is known how many there are at most.
EACH = 200_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df written as a table in the folder that the session names in spark.checkpoint.dir (ValueError if that is unset, but
    for sessions of one machine, which take a temporary folder), and read.

    A table rather than checkpoint(): a checkpoint keeps what is known of its rows' partitioning, which doubles with every join, so that
    planning takes longer than the work after a few rounds of a loop; a table also stores compressed columns. The folder is scratch space:
    its owner clears it after the session.

    rows: df has so many at most. A task then writes EACH of them (but all of the session's tasks take part), so that a table of few rows isn't as many
    files and tasks as a shuffle has partitions.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // EACH)))
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = held.get() if held.isDefined() else None
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        folder = os.path.join(tempfile.gettempdir(), "quillmatch-checkpoints")
    path = f"{folder.rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
