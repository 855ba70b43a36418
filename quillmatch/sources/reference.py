"""References as index tables: built once, in buckets of their keys, sorted."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from quillmatch.functions.titles import DEFAULT, CleaningPolicy, add_clean_key, drop_disabled
from quillmatch.operators.linkage import candidate_index
from quillmatch.sources.scratch import folder


def build_reference(
    rows: DataFrame, keys: Sequence[str], id_col: str, title_col: str, row_no: str, dates: Sequence[str] = (), content_col: str | None = None, extras: Sequence[str] = (),
    marked: Sequence[str] | None = None, policy: CleaningPolicy = DEFAULT,
) -> DataFrame:
    """Payable content to the candidate index: rows with a disabled marker in a text column (those of `marked`, if given) go, titles become clean keys
    (in the last of keys), and each key gets its candidates in order, see candidate_index()."""
    kept = drop_disabled(rows, list(marked) if marked is not None else None, policy)
    return candidate_index(add_clean_key(kept, title_col, keys[-1], policy), keys, id_col, title_col, row_no, dates, content_col, extras)


def save_index(index: DataFrame, name: str, keys: Sequence[str], buckets: int | None = None, path: str | None = None) -> DataFrame:
    """index as the table name, in buckets by keys and sorted within them. A join on keys with statements that are dealt out alike moves no row of it; the
    number of buckets (the session's shuffle partitions by default) then is that of the join's tasks. An older table of the name is replaced."""
    spark = index.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    writer = index.repartition(buckets, *keys).write.mode("overwrite").format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
    (writer if path is None else writer.option("path", path)).saveAsTable(name)
    return spark.table(name)


def index_table(index: DataFrame, keys: Sequence[str], buckets: int | None = None) -> DataFrame:
    """save_index() under a name and in a scratch folder of its own, for a run that joins the index more than once."""
    return save_index(index, f"index_{uuid.uuid4().hex}", keys, buckets, folder(index.sparkSession, "indexes"))


def drop_indexes(spark: SparkSession) -> list[str]:
    """Takes the tables of index_table() out of the session's catalogue (their files stay until the scratch folder is cleared). -> their names."""
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("index_") and len(t.name) == 38]
    for n in names:
        spark.sql(f"DROP TABLE `{n}`")
    return names
