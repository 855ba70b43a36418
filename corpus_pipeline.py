"""The pipeline over documents: toxicity, near-dedup, benchmark decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and gives the rows it keeps, all columns of documents; the last gives token digests. run() writes
every stage as a table in the shared folder and reads it again, so a lost executor costs one stage at most.

- toxicity drops documents that score 0.5 or more; the weights come from the rows of labels whose documents are there.
- near_dedup keeps the least doc_id of each component (five-word shingles, similarity 0.8).
- decontamination drops documents by the 13-word rule; what stays keeps its text.
- secrets puts a mark in place of every secret found; all documents stay.
- bpe encodes and decodes every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmatch.llm import bpe, decontamination, near_dedup, secrets_scan, toxicity
from quillmatch.llm.checkpoints import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.remove_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets_scan.redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, bpe.default_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("bpe", tokenize),
]

#: Trained weights and a tokenizer's merges can't be said in SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
