"""The corpus pipeline: from raw documents to sampled token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from capturelake.llm import language, mixing, sentencepiece, simhash, toxicity
from capturelake.llm.common import bucket, written

#: A document whose language is predicted with a lower score is rejected.
LEAST_LANGUAGE_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null, letterless and ambiguous texts go."""
    model = language.train(docs, bucket("doc_id", 3) != 1)
    return language.identified(docs, model, LEAST_LANGUAGE_SCORE)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.clean(docs, toxicity.train(docs, labels, allowed=bucket("_id", 5) != 0))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document, that with the smallest id."""
    return simhash.representatives(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, model: str = sentencepiece.MODEL) -> DataFrame:
    """Sampled segmentations of every document, by a tokenizer's model file."""
    return sentencepiece.encode(docs, model)


STAGES = [
    ("language", identify_language),
    ("toxicity", remove_toxic),
    ("near_duplicates", remove_near_duplicates),
    ("mix", mix_sources),
    ("encode", encode),
]

#: No SQL: three stages learn a model or sample a lattice.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
