"""Incremental ingest of landed flow files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.vintages import upsert_latest
from tidemark.session import settle
from tidemark.sources import manifest

ROWS_PER_FILE = 2_000_000

LANDED_FLOWS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("category", T.StringType()),
    T.StructField("buy", T.DoubleType()),
    T.StructField("sell", T.DoubleType()),
    T.StructField("net", T.DoubleType()),
    T.StructField("retrieved_at", T.TimestampType()),
])


def read_stream(spark: SparkSession, path: str, schema: T.StructType = LANDED_FLOWS,
                files_per_trigger: int = 1000) -> DataFrame:
    """Landed JSON rows as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, empty as long as no batch has written it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _source(batch: DataFrame) -> str:
    """Names the stream a batch belongs to; a new checkpoint is a new stream."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def _foreach(df: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- X1: landed rows, each content once ------------------------------------------

def landed_rows(spark: SparkSession, table: str, schema: T.StructType = LANDED_FLOWS) -> DataFrame:
    """Rows that ``stream_landed`` has kept, with their ``sha256``."""
    full = T.StructType([*schema.fields, *(T.StructField(c, T.StringType()) for c in ("sha256", "source", "batch"))])
    return _read(spark, table, full).drop("source", "batch")


def land_batch(batch: DataFrame, batch_id: int, source: str, table: str, schema: T.StructType) -> None:
    """Append the rows whose content no other batch has landed.

    The batch owns one folder, and its entries in the manifest of hashes,
    which is read for the months of the batch only.  Entries are written
    before rows: whatever interrupts a batch, no other one lands its rows, and
    a replay leaves its own entries aside and writes both anew.
    """
    date = "date" if "date" in schema.names else None
    hashes = f"{table}/_hashes"
    new = manifest.unseen(batch.select(*schema.names), hashes, source, str(batch_id), date).persist()
    manifest.record(new, hashes, source, str(batch_id))
    new.drop("shard").write.mode("overwrite").parquet(f"{table}/source={source}/batch={batch_id}")
    new.unpersist()


def stream_landed(df: DataFrame, table: str, checkpoint: str, schema: T.StructType = LANDED_FLOWS) -> StreamingQuery:
    """Keep every landed row once, however late it arrives."""
    return _foreach(df, lambda batch, n: land_batch(batch, n, _source(batch), table, schema), checkpoint)


# --- X2: newest revision per key ---------------------------------------------------
# The table holds versions of months.  ``_intents`` gives each batch of each
# stream its version before anything is written, so a replay finds its own;
# ``_versions`` names the months of a version once all of them are written.

_INTENTS = T.StructType([T.StructField("source", T.StringType()), T.StructField("batch", T.LongType()),
                         T.StructField("version", T.LongType())])
_VERSIONS = T.StructType([T.StructField("month", T.DateType()), T.StructField("version", T.LongType())])


def _versioned(spark: SparkSession, table: str, schema: T.StructType, below: int | None = None) -> DataFrame:
    """Rows of the newest published version of each month, of those ``below`` one if given."""
    full = T.StructType([*schema.fields, *_VERSIONS.fields])
    published = _read(spark, f"{table}/_versions", _VERSIONS)
    if below is not None:
        published = published.where(F.col("version") < below)
    newest = published.groupBy("month").agg(F.max("version").alias("version"))
    # The versions are partitions, so this join prunes the files that are read.
    return _read(spark, table, full).join(newest, ["month", "version"], "left_semi")


def current_rows(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """Live rows of a versioned month table: the newest published version of each month."""
    return _versioned(spark, table, schema)


def batch_version(spark: SparkSession, table: str, source: str, batch_id: int) -> int:
    """The version of a batch: the one it was given before, else the next of the table."""
    given = _read(spark, f"{table}/_intents", _INTENTS)
    mine = F.when((F.col("source") == source) & (F.col("batch") == batch_id), F.col("version"))
    row = given.agg(F.min(mine).alias("mine"), F.max("version").alias("last")).first()
    if row["mine"] is not None:
        return row["mine"]
    version = 0 if row["last"] is None else row["last"] + 1
    spark.createDataFrame([(source, batch_id, version)], _INTENTS).coalesce(1).write.mode("append").parquet(f"{table}/_intents")
    return version


def upsert_batch(batch: DataFrame, batch_id: int, source: str, table: str, schema: T.StructType, keys, ts: str) -> None:
    """Rewrite only the months a batch touches, as a new version of them.

    One writer at a time.  A replayed batch keeps its version, reads only older
    ones and overwrites its own folders, so it can run again at any point; rows
    of a version are seen once all its months are written.
    """
    spark = batch.sparkSession
    columns = schema.names
    version = batch_version(spark, table, source, batch_id)
    fresh = upsert_latest(
        batch.select(*columns).limit(0), batch.select(*columns), keys, ts
    ).withColumn("month", F.trunc("date", "month")).persist()
    months = fresh.select("month").distinct()
    old = _versioned(spark, table, schema, below=version).join(months, "month", "left_semi").select(*columns)
    merged = upsert_latest(old, fresh.select(*columns), keys, ts)
    out = merged.withColumn("month", F.trunc("date", "month")).withColumn("version", F.lit(version).cast("long"))
    (
        out.repartition("month").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", ROWS_PER_FILE)
        .partitionBy("month", "version").parquet(table)
    )
    months.withColumn("version", F.lit(version).cast("long")).coalesce(1).write.mode("append").parquet(f"{table}/_versions")
    fresh.unpersist()


def vacuum(spark: SparkSession, table: str) -> int:
    """Delete versions of months that a newer published one replaces; returns how many."""
    published = _read(spark, f"{table}/_versions", _VERSIONS).distinct()
    newest = published.groupBy("month").agg(F.max("version").alias("newest"))
    stale = published.join(newest, "month").where("version < newest").select("month", "version").collect()
    deleted = 0
    for row in stale:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/month={row.month}/version={row.version}")
        deleted += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return deleted


def stream_upsert(df: DataFrame, table: str, keys, ts: str, checkpoint: str,
                  schema: T.StructType = LANDED_FLOWS) -> StreamingQuery:
    """Latest revision wins across micro-batches, restarts and streams; late months are rewritten."""
    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_batch(batch, batch_id, _source(batch), table, schema, keys, ts)

    return _foreach(df, write, checkpoint)


# --- X3: monthly flows ---------------------------------------------------------------

MONTHLY_PARTS = T.StructType([
    T.StructField("month", T.DateType()), T.StructField("category", T.StringType()),
    T.StructField("net", T.DoubleType()), T.StructField("date", T.DateType()),
])


_PART_ROWS = T.StructType([*MONTHLY_PARTS.fields, T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())])
_BASES = T.StructType([T.StructField("version", T.LongType()), T.StructField("source", T.StringType()), T.StructField("through", T.LongType())])


def _newest_base(spark: SparkSession, table: str) -> tuple[int | None, DataFrame]:
    """Version of the newest base, and the last batch of each source that it holds."""
    bases = _read(spark, f"{table}/_bases", _BASES)
    newest = bases.agg(F.max("version")).first()[0]
    return newest, bases.where(F.col("version") == newest).select("source", "through")


def _base_rows(spark: SparkSession, table: str, version: int | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], MONTHLY_PARTS)
    return spark.read.schema(MONTHLY_PARTS).parquet(f"{table}/_base/version={version}")


def _live_parts(spark: SparkSession, table: str, through: DataFrame) -> DataFrame:
    """Partial sums of the batches that no base holds."""
    parts = _read(spark, table, _PART_ROWS).join(through, "source", "left")
    return parts.where("through is null or batch > through").drop("through")


def _monthly_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("month", "category").agg(F.sum("net").alias("net"), F.max("date").alias("date"))


def monthly_batch(batch: DataFrame, batch_id: int, source: str, table: str) -> None:
    """Write the partial sums of a batch into its own folder; one that a base holds is left alone."""
    _, through = _newest_base(batch.sparkSession, table)
    if through.where((F.col("source") == source) & (F.col("through") >= batch_id)).isEmpty():
        parts = _monthly_sums(batch.withColumn("month", F.trunc("date", "month")))
        parts.write.mode("overwrite").parquet(f"{table}/source={source}/batch={batch_id}")


def stream_monthly_flows(df: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Net flow per month and category, kept as one partial sum per batch.

    A batch owns one folder, which a replay writes anew.  No state waits for a
    watermark, so a month may receive rows at any time.
    """
    return _foreach(df, lambda batch, n: monthly_batch(batch, n, _source(batch), table), checkpoint)


def monthly_flows(spark: SparkSession, table: str) -> DataFrame:
    """Sums over all batches that ``stream_monthly_flows`` has written: the newest base and what came after it."""
    version, through = _newest_base(spark, table)
    live = _live_parts(spark, table, through).select(*MONTHLY_PARTS.names)
    return _monthly_sums(_base_rows(spark, table, version).unionByName(live))


def compact_monthly_flows(spark: SparkSession, table: str) -> int | None:
    """Merge the partial sums of finished batches into a new base; returns the newest version.

    The newest batch of each source stays out, as it may still be replayed.
    Batches of a source come in order, so one number per source says which are
    held.  The base is written before the row that publishes it: an interrupted
    run changes nothing that readers see, and the next one writes it again.
    One compaction at a time; streams may go on.
    """
    newest, through = _newest_base(spark, table)
    parts = _live_parts(spark, table, through)
    finished = parts.groupBy("source").agg((F.max("batch") - 1).alias("through"))
    held = settle(through.unionByName(finished).groupBy("source").agg(F.max("through").alias("through")))
    merged = parts.join(held, "source").where("batch <= through").select(*MONTHLY_PARTS.names)
    if merged.isEmpty():
        return newest
    version = 0 if newest is None else newest + 1
    sums = _monthly_sums(_base_rows(spark, table, newest).unionByName(merged))
    sums.write.mode("overwrite").parquet(f"{table}/_base/version={version}")
    held.select(F.lit(version).cast("long").alias("version"), "source", "through").coalesce(1).write.mode("append").parquet(f"{table}/_bases")
    return version


def vacuum_monthly_flows(spark: SparkSession, table: str) -> int:
    """Delete batch folders that the newest base holds and older bases; returns how many.

    Run it when no reader of an older base is left.
    """
    newest, through = _newest_base(spark, table)
    held = {r.source: r.through for r in through.collect()}
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(table).getFileSystem(spark._jsc.hadoopConfiguration())
    deleted = 0
    for status in files.globStatus(hadoop(f"{table}/source=*/batch=*")) or ():
        path = status.getPath()
        source, batch = path.getParent().getName().split("=", 1)[1], int(path.getName().split("=", 1)[1])
        if batch <= held.get(source, -1):
            deleted += files.delete(path, True)
    for version in range(newest or 0):
        deleted += files.delete(hadoop(f"{table}/_base/version={version}"), True)
    return deleted
