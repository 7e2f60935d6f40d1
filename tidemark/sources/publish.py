"""Publication in one step: staged outputs, every check, then a switch.

Outputs are written to a folder of their own run, which no reader looks into.
The checks read what was written, all of them in one job.  Only then a new
version of the published set is named, in one small file: until it is there,
readers see the set before, and a failed check or an interrupted run changes
nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quality import DataQualityError
from tidemark.sources.sinks import content_hash

#: A check gets all staged outputs by name and returns the rows that break it.
Check = Callable[[Mapping[str, DataFrame]], DataFrame]

_SET = T.StructType([
    T.StructField("version", T.LongType()), T.StructField("name", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("hash_xor", T.LongType()), T.StructField("hash_sum", T.DecimalType(38, 0)),
])


def _filesystem(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Versions whose file is complete."""
    system, place = _filesystem(spark, f"{root}/_published")
    if not system.exists(place):
        return []
    names = [s.getPath() for s in system.listStatus(place)]
    done = [p.getName() for p in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("v")) for n in done)


def published_set(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The outputs of a version, by default the newest: ``version, name, path, rows, hash_xor, hash_sum``."""
    known = _versions(spark, root)
    if not known:
        return spark.createDataFrame([], _SET)
    return spark.read.schema(_SET).parquet(f"{root}/_published/v{known[-1] if version is None else version}")


def published(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A published output."""
    rows = published_set(spark, root, version).where(F.col("name") == name).collect()
    if not rows:
        raise KeyError(f"Not published: {name}")
    return spark.read.parquet(f"{root}/{rows[0].path}")


def broken_checks(staged: Mapping[str, DataFrame], checks: Mapping[str, Check]) -> DataFrame:
    """``check, rows, example`` of the checks that rows break, found together."""
    if not checks:
        return next(iter(staged.values())).sparkSession.createDataFrame([], "check string, rows long, example string")
    found = reduce(DataFrame.unionByName, [
        bad.select(F.lit(message).alias("check"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in bad.columns])).alias("example"))
        for message, bad in ((m, check(staged)) for m, check in checks.items())])
    return found.groupBy("check").agg(F.count(F.lit(1)).alias("rows"), F.min("example").alias("example"))


def publish(outputs: Mapping[str, DataFrame], checks: Mapping[str, Check], root: str) -> int:
    """Publish outputs together if no check finds a row; returns the version.

    An output that is not given keeps its published state, and checks see it
    as published.  Raises ``DataQualityError`` with every broken check, how
    many rows break it and one of them.  Of two writers at once the later one
    fails, as its version is taken.
    """
    spark = next(iter(outputs.values())).sparkSession
    known = _versions(spark, root)
    before = {r.name: r for r in published_set(spark, root).collect()}
    version, run = (known[-1] + 1 if known else 0), f"_staged/run-{uuid.uuid4().hex[:12]}"
    for name, df in outputs.items():
        df.write.parquet(f"{root}/{run}/{name}")
    staged = {name: spark.read.schema(df.schema).parquet(f"{root}/{run}/{name}") for name, df in outputs.items()}
    kept = {name: spark.read.parquet(f"{root}/{row.path}") for name, row in before.items() if name not in outputs}
    broken = broken_checks(staged | kept, checks).orderBy("check").collect()
    if broken:
        system, place = _filesystem(spark, f"{root}/{run}")
        system.delete(place, True)
        raise DataQualityError("; ".join(f"{r.check}: {r['rows']} rows, as {r.example}" for r in broken))
    entries = [content_hash(df).select(
        F.lit(version).cast("long").alias("version"), F.lit(name).alias("name"), F.lit(f"{run}/{name}").alias("path"), "rows", "hash_xor",
        F.col("hash_sum").cast("decimal(38,0)").alias("hash_sum")) for name, df in staged.items()]
    if kept:
        entries.append(published_set(spark, root).where(F.col("name").isin(list(kept))).withColumn("version", F.lit(version).cast("long")))
    reduce(DataFrame.unionByName, entries).coalesce(1).write.mode("errorifexists").parquet(f"{root}/_published/v{version}")
    return version


def verify_published(spark: SparkSession, root: str) -> DataFrame:
    """``name, rows, same``: whether what is stored is still what was published."""
    parts = []
    for row in published_set(spark, root).collect():
        now = content_hash(spark.read.parquet(f"{root}/{row.path}"))
        parts.append(now.select(F.lit(row.name).alias("name"), "rows", (
            (F.col("rows") == row["rows"]) & F.col("hash_xor").eqNullSafe(F.lit(row.hash_xor).cast("long"))
            & F.col("hash_sum").cast("decimal(38,0)").eqNullSafe(F.lit(row.hash_sum).cast("decimal(38,0)"))).alias("same")))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "name string, rows long, same boolean")


def retire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete runs that none of the newest ``keep`` versions names, such as interrupted ones; returns how many.

    Not while another run is staging.
    """
    known = _versions(spark, root)[-keep:]
    named = {r.path.rsplit("/", 1)[0] for v in known for r in published_set(spark, root, v).collect()}
    system, place = _filesystem(spark, f"{root}/_staged")
    runs = [s.getPath() for s in system.listStatus(place)] if system.exists(place) else []
    gone = [p for p in runs if f"_staged/{p.getName()}" not in named]
    for path in gone:
        system.delete(path, True)
    return len(gone)
