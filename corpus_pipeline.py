"""A training corpus from ``documents``: quality, near duplicates, benchmark leaks, mixing, token records."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import leaks, mixing, near, quality, records
from tidemark.llm.store import plain_names, stored

#: Shares of the tokens that are left after the quality stage.
TARGETS = {"prime": 0.99, "toxic": 0.01}
#: SQL can't express the trained models, the tokenizer or reachability over links; tests hold stages against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; columns as they were."""
    docs, restore = plain_names(docs)
    scored = quality.with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return restore(scored.filter(F.col("score") >= quality.THRESHOLD))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of the smallest id, once; a null id stays, once for each text."""
    docs, restore = plain_names(docs)
    kept = near.near_duplicates(docs).filter("kept and doc_id is not null").select(F.col("doc_id").alias("kept_id")).distinct()
    named = docs.join(kept, F.col("doc_id").cast("long") == F.col("kept_id")).drop("kept_id").dropDuplicates(["doc_id"])
    unnamed = docs.filter("doc_id is null").dropDuplicates(["text"])
    return restore(named.unionByName(unnamed))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark phrase."""
    docs, restore = plain_names(docs)
    found = leaks.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("contaminated").select(
        F.col("doc_id").alias("leak_id"), "text_hash").distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("leak_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    return restore(docs.join(found, same, "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate towards the target weights says."""
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), TARGETS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token records of the corpus, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    return records.token_records(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
