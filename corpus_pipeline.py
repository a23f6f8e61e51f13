"""Clean a corpus: drop toxic and poor documents, near duplicates and personal data, then pack it.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dqspark.llm import packing, pii, quality, simhash, toxicity
from dqspark.llm.text import fold, table
from dqspark.session import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the CRF scores below 0.3; it learns from the labels of three folds in four."""
    crf = toxicity.train(docs, table(spark, sf_dir, "labels").where(fold(4) != 2))
    return toxicity.keep_clean(docs, crf)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good; it learns from the labels of two folds in three."""
    weights = quality.train(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    return quality.keep_good(docs, weights)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates."""
    return simhash.keep_first(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the tag of its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, batch."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_copies), ("pii", redact),
    ("packing", pack),
]
#: Trained models decide two stages, which SQL cannot express; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
