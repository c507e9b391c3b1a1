"""The training-data pipeline: toxicity, near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), docs being what its predecessor left, and returns a DataFrame; all but the last
keep the columns of ``documents`` and any others, whatever their names. Between stages ``run`` writes Parquet to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notegrove import ship
from notegrove.llm import packing, pii, simhash, substring, toxicity
from notegrove.llm._common import beside, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under 0.7; the model learns from the labels of those in ``docs``."""
    ship(spark)
    labels = table(spark, sf_dir, "labels")
    return beside(docs, ["doc_id", "text"], lambda df: toxicity.toxicity(df, labels).where(F.col("score") < 0.7))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that repeat an earlier passage of 20 words or more."""
    ship(spark)
    return substring.dedup_texts(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by their kinds."""
    ship(spark)
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 1024 tokens."""
    ship(spark)
    return packing.best_fit_packing(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("substring", drop_repeats), ("pii", redact), ("packing", pack)]

#: A learnt score and a tokenizer stand in the way of SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
