"""Landed files: newest snapshot, append-only landing, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import col


def landing_id(path) -> F.Column:
    """What the files of one write have in common: the job's id in part names, else the file's own path."""
    job = F.regexp_extract(col(path), "/part-[0-9]+-([0-9a-f-]{36})[^/]*$", 1)
    return F.when(job != "", job).otherwise(col(path))


def latest_landing(df: DataFrame, keys, date_dir: str = "date_dir", mtime: str = "file_time",
                   name: str = "file_path") -> DataFrame:
    """Rows of the newest landing per source by (date folder, time), all its part files.

    A landing is as new as its newest file.  It is found among distinct
    landings by aggregation, so a source with most of the rows never becomes
    one sort.
    """
    keys = list(keys)
    marked = df.withColumn("_landing", landing_id(name))
    landings = marked.groupBy(*keys, date_dir, "_landing").agg(F.max(mtime).alias("_time"))
    newest = landings.groupBy(*keys).agg(F.max(F.struct(date_dir, "_time", "_landing")).alias("_newest")).select(
        *keys, F.col("_newest").getField(date_dir).alias(date_dir), F.col("_newest._landing").alias("_landing"))
    return marked.join(newest, [*keys, date_dir, "_landing"], "left_semi").drop("_landing")


def daily_last(ticks: DataFrame, market: str = "market", ts: str = "ts", price: str = "price",
               tie: str | None = None) -> DataFrame:
    """Last price per calendar date and market."""
    order = F.struct(col(ts), col(tie)) if tie else col(ts)
    return ticks.where(col(price).isNotNull()).groupBy(
        col(market).alias("market"), F.to_date(col(ts)).alias("date")
    ).agg(F.max_by(col(price), order).alias("price"))


def checksum(columns) -> F.Column:
    """sha256 of a row's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def land_new(df: DataFrame, manifest: DataFrame, columns=None) -> DataFrame:
    """Rows whose content is not in the manifest yet, each content once."""
    columns = list(columns or df.columns)
    marked = df.withColumn("sha256", checksum(columns))
    once = marked.dropDuplicates(["sha256"])
    return once.join(manifest.select("sha256"), "sha256", "left_anti")


def append_landing(new: DataFrame, path: str) -> None:
    """Append landed rows below their retrieval date."""
    new.withColumn("retrieved_date", F.to_date("retrieved_at")).write.mode("append").partitionBy(
        "retrieved_date"
    ).parquet(path)


def with_snapshot_fallback(fresh: DataFrame, landed: DataFrame, keys, order: str = "retrieved_at") -> DataFrame:
    """Fresh rows, plus the newest landed snapshot of keys the batch lacks."""
    keys = list(keys)
    missing = landed.join(fresh.select(*keys).distinct(), keys, "left_anti")
    newest = missing.groupBy(*keys).agg(F.max(order).alias(order))
    fallback = missing.join(newest, [*keys, order], "left_semi")
    return fresh.withColumn("fallback", F.lit(False)).unionByName(
        fallback.withColumn("fallback", F.lit(True))
    )


def conflicting_duplicates(df: DataFrame, keys) -> DataFrame:
    """Keys whose repeated rows disagree."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    versions = F.count_distinct(F.xxhash64(*rest))
    return df.groupBy(*keys).agg(versions.alias("versions")).where("versions > 1")


def dedupe_consistent(df: DataFrame, keys) -> DataFrame:
    """Collapse identical repeats; disagreeing ones are an error at run time."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    low, high = F.min(F.struct(*rest)), F.max(F.struct(*rest))
    merged = df.groupBy(*keys).agg(low.alias("_row"), low.eqNullSafe(high).alias("_same"))
    row = F.when(F.col("_same"), F.col("_row")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit("Conflicting rows for"), *[col(k).cast("string") for k in keys]))
        .cast(df.select(F.struct(*rest)).schema[0].dataType)
    )
    return merged.withColumn("_row", row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
