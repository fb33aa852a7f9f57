"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, nearcopies, packing, pii, quality
from tidemark.llm.common import load, materialise
from tidemark.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    ship(spark)
    return quality.keep(docs, quality.model_for(docs, load(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles of similarity 0.8 or more."""
    ship(spark)
    return nearcopies.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of fewer than two benchmark items, without the passages they share with one."""
    ship(spark)
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    ship(spark)
    return pii.redact(docs, pii.train(docs))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("dedup", dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pii", pii_stage),
    ("pack", pack_stage),
]

#: learned models and tokenizers cannot be said in SQL; the tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
