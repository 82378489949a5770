"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their
columns; the last returns what was written for training.  Stages are meant to be
written and read back one by one; ``run`` does that in the shared folder.

Defined cases, in every stage: null and empty texts are clean, near-duplicates of nothing
and taken once by the mix; null and repeated doc_ids are rows like others; a stage that
keeps rows gives them with all their columns, whatever those are called; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import op2_token_ids, op3_mixing, op5_toxicity, op6_near_dedup, op10_decontamination
from paperloom.llm.common import scratch, stored, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the severity model rejects."""
    return op5_toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class."""
    return op6_near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark item was found."""
    return op10_decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the source weights take it (repeats are rows)."""
    return op3_mixing.repeat(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the mix as token-id files; one row per document read back from them."""
    return op2_token_ids.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Models, signatures, latent retrieval and tokenizers are beyond SQL; tests
#: hold the operators against brute force, and of the stages only columns and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what a stage wrote for itself goes when its documents are written
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", lasting=True)
    return STAGES[-1][1](spark, docs, sf_dir)
