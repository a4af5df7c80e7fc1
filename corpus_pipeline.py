"""The corpus pipeline: five operators of palimpsest.llm, one after the other.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  ``run`` writes each stage's result to the shared folder as Parquet and
reads it again as the next one's input, so a lost executor costs one stage at most.
Repeated rows, texts of any length and empty tables go through every stage.
The rows of the result need tokenizers and trained models, so there is no SQL for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, jaccard_join, pii, toxicity
from palimpsest.llm.common import materialize
from palimpsest.llm.queries import packed, table

ORACLE_SQL = None


def toxic_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't predict to be toxic; null and empty texts stay, and all where a label is missing."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("y"))
    return toxicity.remove_toxic(docs, labels)


def near_duplicates_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard 0.75 on five-word shingles connect, the least id's; those without words all stay."""
    return jaccard_join.keep_one(docs, size=5, num=75, den=100)


def benchmark_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item; null and empty texts stay."""
    return decontamination.remove_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def personal_data_replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null."""
    return pii.redact_documents(docs)


def sequences_packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, with their ids; a null or empty text is its end id."""
    return packed(docs)


STAGES = [
    ("toxicity", toxic_removed),
    ("ngram_jaccard_join", near_duplicates_removed),
    ("benchmark_decontamination", benchmark_removed),
    ("pii", personal_data_replaced),
    ("packing", sequences_packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
