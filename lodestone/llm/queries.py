"""Queries of the ten operators: each applies one, with its production parameters, to a whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir
from . import chat_format, decontaminate, html_extract, license_scan, minhash_dedup, packing, quality_rules, substring_dedup, token_output, toxicity

QUERIES, ORACLES = {}, {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_format(_table(spark, sf_dir, "conversations"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, with their metrics."""
    return quality_rules.verdicts(_table(spark, sf_dir, "documents")).where("failed = ''")


QUERIES |= {"op1_chat_format": op1_chat_format, "op2_quality_rules": op2_quality_rules}
ORACLES |= {"op1_chat_format": chat_format.ORACLE, "op2_quality_rules": quality_rules.ORACLE}


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op4_minhash_dedup"] = op4_minhash_dedup


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


QUERIES["op8_substring_dedup"] = op8_substring_dedup


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES["op5_decontaminate"] = op5_decontaminate


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in slot order, written to shard files in a new folder of the shared one and read back from them."""
    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    return token_output.stored_records(token_output.training_order(_table(spark, sf_dir, "documents")), folder)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_conversations(_table(spark, sf_dir, "conversations"))


QUERIES |= {"op3_token_output": op3_token_output, "op10_packing": op10_packing}


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_findings(_table(spark, sf_dir, "documents"))


QUERIES["op6_license_scan"] = op6_license_scan


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxic_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


QUERIES |= {"op7_toxicity": op7_toxicity, "op9_html_extract": op9_html_extract}
