"""From raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import decontaminate, exact_dedup, minhash, packing, quality
from skyloom.llm.common import table, written


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under a model of trusted text is within their language's threshold."""
    return quality.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def keep_one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the one with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the one with the least doc_id."""
    return minhash.drop_near_copies(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit fewer than one word in twenty."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents' pieces in sequences of 4096 ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good_quality),
    ("exact dedup", keep_one_of_equal),
    ("MinHash near-dedup", keep_one_of_near),
    ("benchmark decontamination", keep_uncontaminated),
    ("best-fit packing", pack_sequences),
]

#: SQL knows neither the language model nor the tokenizer; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
