"""The corpus pipeline: five operators of lodestone.llm applied to documents, one after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents,
in their order, with n_chars brought up to date where texts were cut. ``run`` writes each stage's result to the
shared folder and reads it again as the next one's input, so a lost executor costs no stage before.

1. quality_rules: documents that fail a rule go.
2. near_dedup: of each group of near copies the smallest doc_id stays.
3. substring_dedup: a passage of 50 words or more that a smaller doc_id has too is cut; a document of which no word is left goes.
4. decontaminate: benchmark phrases are cut; a document of which no word is left goes.
5. packing: all documents that are left, in packs under limits on tokens, segments and loss-bearing tokens.

No SQL expresses the stages after the first, so ``ORACLE_SQL`` is None; tests hold each stage against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import decontaminate, minhash_dedup, packing, quality_rules, substring_dedup
from lodestone.session import Scratch

ORACLE_SQL = None


def _counted(cut: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars as the texts are now."""
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*[F.col(f"`{c}`") for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_dedup.keep_one(docs)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(substring_dedup.remove_repeats(docs), docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _counted(decontaminate.decontaminate(docs, benchmark), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring), ("decontaminate", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if before:
            scratch.drop(before)
        before = name
    return docs
