"""Hashes of everything landed, in shards, so that a batch reads only the shards it holds.

Equal rows have equal hashes and, where a date column is named, equal dates.  A
shard is a month of that date, or the first hex digits of the hash without a
date: a function of the content alone, so a row can only have landed before in
its own shard.  A batch lists and reads its own shards' folders; what other
months hold is never touched, however long the history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import col
from tidemark.sources.landing import checksum

HASHES = T.StructType([T.StructField(c, T.StringType()) for c in ("sha256", "source", "batch")])
SHARDED = T.StructType([*HASHES.fields, T.StructField("shard", T.StringType()), T.StructField("part", T.StringType())])
#: Hex digits of a shard without a date.
DIGITS = 1
#: Files of a shard from which on it is worth merging them.
MANY_FILES = 8


def marked(df: DataFrame, columns=None, date: str | None = None) -> DataFrame:
    """Rows with the hash of ``columns`` (all by default) and its shard."""
    hashed = df.withColumn("sha256", checksum(list(columns or df.columns)))
    if date is None:
        return hashed.withColumn("shard", F.substring("sha256", 1, DIGITS))
    return hashed.withColumn("shard", F.coalesce(F.date_format(col(date).cast("date"), "yyyy-MM"), F.lit("undated")))


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _folders(spark: SparkSession, path: str, shards) -> list[str]:
    """Folders of the shards that exist."""
    system, place = _filesystem(spark, path)
    there = {s.getPath().getName() for s in system.listStatus(place)} if system.exists(place) else set()
    return [f"{path}/shard={s}" for s in shards if f"shard={s}" in there]


def held(spark: SparkSession, path: str, shards) -> DataFrame:
    """``sha256, source, batch, shard, part`` of some shards; only their folders are listed."""
    folders = _folders(spark, path, sorted(set(shards)))
    if not folders:
        return spark.createDataFrame([], SHARDED)
    return spark.read.schema(SHARDED).option("basePath", path).parquet(*folders)


def unseen(df: DataFrame, path: str, source: str = "", batch: str = "", date: str | None = None, columns=None) -> DataFrame:
    """Rows whose content no other batch has landed, each content once, with ``sha256`` and ``shard``.

    What this batch itself has recorded doesn't count, so it can run again.
    The driver learns the names of the batch's shards, not its rows.
    """
    once = marked(df, columns, date).dropDuplicates(["sha256"])
    shards = [r.shard for r in marked(df, columns, date).select("shard").distinct().collect()]
    others = held(df.sparkSession, path, shards).where(~((F.col("source") == source) & (F.col("batch") == batch)))
    return once.join(others.select("shard", "sha256"), ["shard", "sha256"], "left_anti")


def record(new: DataFrame, path: str, source: str = "", batch: str = "") -> None:
    """Enter the hashes of a batch; a batch that runs again overwrites its own entries."""
    rows = new.select("sha256", F.lit(source).alias("source"), F.lit(batch).alias("batch"), "shard", F.lit(f"{source}-{batch}").alias("part"))
    # Small shards share a task and a shard of most rows is split.
    rows.hint("rebalance", "shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard", "part").parquet(path)


def compact(spark: SparkSession, path: str, shards, many: int = MANY_FILES) -> int:
    """Merge the entries of shards that have many files; returns how many shards were merged.

    Entries keep the batch they came from, so a batch can still run again.  The
    merged file is complete before the old ones go, and an entry that is there
    twice counts once.  One writer at a time.
    """
    merged = 0
    for folder in _folders(spark, path, shards):
        system, place = _filesystem(spark, folder)
        parts = [s.getPath().toString() for s in system.listStatus(place)]
        if len(parts) < many:
            continue
        rows = spark.read.schema(HASHES).parquet(*parts)
        rows.distinct().coalesce(1).write.parquet(f"{folder}/part=merged-{uuid.uuid4().hex[:12]}")
        for part in parts:
            system.delete(spark._jvm.org.apache.hadoop.fs.Path(part), True)
        merged += 1
    return merged
