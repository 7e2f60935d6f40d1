"""Tables written to the folder that all executors share, and connected components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several passes read, and read it back.

    The files are in the folder of ``spark.checkpoint.dir``: lineage ends
    there, and a lost executor takes nothing with it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later pass reads."""
    for table in tables:
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def plain_names(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The documents with neutral names for all columns but ``doc_id`` and ``text``, and what puts the names back.

    So columns that an operator adds cannot clash with those a table brings.
    """
    names = docs.columns
    held = [c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(names)]
    return docs.toDF(*held), lambda out: out.select(*held).toDF(*names)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b`` (long) pairs: one ``node, root`` row per node.

    The root is the smallest node.  Alternating stars: every node points its
    larger neighbours at its smallest one, then its smaller neighbours too,
    until the edges are stars.  A round is two aggregations by node that
    combine before the shuffle; a hub joins with its one minimum, so its
    edges can be split over tasks.
    """
    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs if not larger else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = both.join(low, "a")
        if larger:  # neighbours above the node
            return out.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        return out.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            low.select("a", F.col("m").alias("b"))).filter("a > b").distinct()

    pairs = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    seen = None
    while True:
        now = stored(star(star(pairs, True), False), "links")
        discard(pairs)
        pairs = now
        mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen = mark
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
