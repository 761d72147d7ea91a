"""From raw documents to training shards: five stages, each written before the next begins.

Every stage gets all that its predecessor kept and returns the columns of documents, the last
one a digest of the shards it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from garbline.llm import decontamination, language, mixing, ngram_join, training_order
from garbline.session import configure, cut_lineage


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a learned language go."""
    return language.speakable(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id stays."""
    return ngram_join.representatives(spark, docs, sf_dir)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a test item go."""
    return decontamination.uncontaminated(spark, docs, sf_dir)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the target weights of their sources ask."""
    return mixing.mixed(spark, docs, sf_dir)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences in training order."""
    return training_order.materialised(spark, docs, sf_dir)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("source mixing", source_mix),
    ("token-ID output", token_shards),
]
# Classifier, similarity join and tokenizer are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
