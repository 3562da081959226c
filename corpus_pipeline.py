"""Corpus pipeline over ``documents``: quality, exact and near duplicates, benchmark
passages, packing. Each stage is one operator of ``tessera.llm`` on all rows that the
stage before it kept; what it returns is written as Parquet and read again.
"""
from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, packing, simhash, subword, winnowing
from tessera.session import discard, release, written_alone


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stage(stage):
    """A stage begins by letting go of what the stages before it left on the driver."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword classifier predicts 1."""
    return subword.keep_quality(docs, _table(spark, sf_dir, "labels"))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original, then the smallest doc_id."""
    return exact_dedup.drop_exact(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id."""
    return simhash.drop_near(docs, shingle=3, distance=2)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return winnowing.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens placed in sequences."""
    return packing.packed(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL has no subword classifier, tokenizer or XXH64
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs, before = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written_alone(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
