"""The corpus pipeline: five stages over documents, each reading what the one before it wrote.

Toxic documents go, one document of each near-duplicate class stays, documents that hold a benchmark item go, personal data
turns into placeholders, and the rest is encoded and decoded by byte-level BPE. Every stage but the last returns the columns of
documents, whatever their names; rows with nulls, empty texts or equal ids pass through the stages by the rules of their
operators: empty texts are not toxic, hold no item, stay once (they are copies of each other) and have no ids. An empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontaminate, near_dedup, pii, toxicity
from gridloom.llm.common import discard, table, written
from gridloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", remove_toxic),
    ("minhash near-dedup", remove_near_duplicates),
    ("benchmark decontamination", remove_benchmark_leaks),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: No stage is plain SQL: trees, signatures, classifier and merges are learned or hashed. tests/llm/test_pipeline.py holds each stage against brute force on its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written as Parquet to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, path = written(docs, f"stage-{k}")
            if before:
                discard(spark, before)  # nothing reads the stage before any more
            before = path
    return docs
