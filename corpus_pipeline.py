"""A corpus pipeline of five stages: toxicity, near copies, benchmark passages, secrets,
tokens.

Each stage takes the documents that its predecessor kept and returns those that it
keeps, with all their columns; the last returns token ids.  ``run`` writes each stage's
result to the shared folder and reads it again, as a cluster job would, so a lost
executor never runs an earlier stage anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.llm import bpe, decontaminate, secrets, simhash, toxicity
from rowloom.llm.common import remainder, scratch_path
from rowloom.llm.queries import table, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model learns from the rows that are not held out."""
    learned = remainder(F.col("doc_id"), 3) != 1
    model = toxicity.learn(docs.where(learned), table(spark, sf_dir, "labels").where(learned))
    return toxicity.without_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return simhash.without_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words in benchmark windows go."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay."""
    return secrets.without_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of its round trip."""
    return bpe.round_trip(docs, tokenizer(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None
"""Learning, SimHash and BPE have no SQL; tests/llm compares the stages with plain Python."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
