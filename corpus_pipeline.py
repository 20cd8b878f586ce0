"""A corpus from raw documents to packed training sequences, in stages that are written and reread."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from batchloom.llm import op02_balance, op05_oddsketch, op08_slack, op09_secrets, op10_ppm
from batchloom.llm.queries import BYTE_BPE, WORD_BPE
from batchloom.llm.store import landed
from batchloom.session import package_on_workers


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no learned language go; sure predictions are written into lang."""
    package_on_workers(spark)
    return op10_ppm.keep_identified(docs, op10_ppm.fit_parts(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates (0.8 of five-word shingles) stays: that of the smallest doc_id."""
    package_on_workers(spark)
    return op05_oddsketch.keep_one(docs, similar=(80, 100))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced inside the texts; every document stays."""
    package_on_workers(spark)
    return op09_secrets.redact(docs, public_tokenizers.path(BYTE_BPE))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows appear as often as the balanced mix takes them."""
    mixed = landed(op02_balance.mix(docs, exact_words=False), "mixed")
    return op02_balance.materialise(docs, mixed)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of every document with their sequence and offset."""
    package_on_workers(spark)
    # workers here have run the other stages before, so the encoder gets less memory
    return op08_slack.pack(docs, public_tokenizers.path(WORD_BPE), memo=100_000)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Models, sketches and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
