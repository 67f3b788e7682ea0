"""The corpus pipeline: toxicity, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last have the columns of documents. All stages carry
columns of any name, read whole texts, and give an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import mixing, pieces, privacy, similarity, toxicity
from sluice.llm.common import documents, written


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.7 or more; learns from the labels of two thirds of the ids.

    Null and empty texts score as one plain sentence; repeated rows score alike, and rows with a null doc_id are scored too.
    Without toxic or without clean labels nothing is learnt.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    return toxicity.clean(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that links of likeness 0.8 or more in five-word shingles make.

    It is that of the least doc_id, a null one last; of repeated rows one stays; null and empty texts are like nothing and stay.
    """
    return similarity.one_of_each(docs, k=5, percent=80)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [kind] for each span of personal data. Null texts stay null; repeated rows are treated alike; n_chars follows the text."""
    return privacy.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks. A null source is one; rows that share source and doc_id draw alike; documents
    without words stay or go by their source's rate."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids of pieces instead of their texts; null for a null text, none for an empty one; repeated rows stay."""
    return pieces.encode(docs)


STAGES = [("toxicity", clean_language), ("near_duplicates", near_duplicates), ("private_data", private_data), ("mixing", mix), ("encoding", encode)]
#: SQL can't express the stages; they are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
