"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontaminate, divergence, fingerprints, hard_negatives, html_extract, licenses, near_dedup, pii, quality, substring_dedup, token_files, toxicity
from gridloom.llm.common import table


def tokenizer_path(name: str) -> str:
    """A public tokenizer's file: in the folder GRIDLOOM_TOKENIZERS if that is set, else where the installed package has it."""
    folder = os.environ.get("GRIDLOOM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, files = token_files.write_corpus(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_files.read_corpus(spark, folder, files)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of the labels is moved by one, so that a label's rows aren't the anchor's likes alone."""
    rows = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_quality_rules, op2_html_extraction, op3_license_scan, op4_near_dedup, op5_token_files, op6_pii, op7_bpe, op8_toxicity, op9_decontamination, op10_substring_dedup, op11_hard_negatives, op12_fingerprints, op13_source_divergence)
}
ORACLES: dict[str, str] = {"op11_hard_negatives": hard_negatives.SQL, "op13_source_divergence": divergence.SQL}
