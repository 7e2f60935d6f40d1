"""Artifact sinks and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_outputs(outputs: dict[str, DataFrame], roots, target: str | None = None,
                  fmt: str = "parquet") -> list[str]:
    """Write every registered output, or one, below each root.

    The frames are lazy, so a target computes only itself.  The first root is
    written from the plan; the others copy it, so both hold the same rows even
    if a source changes in between.
    """
    if target is not None and target not in outputs:
        raise ValueError(f"Unknown output: {target}")
    first, *copies = list(roots)
    written = []
    for name, df in outputs.items():
        if target is not None and name != target:
            continue
        df.write.mode("overwrite").format(fmt).save(f"{first}/{name}")
        for root in copies:
            stored = df.sparkSession.read.format(fmt).schema(df.schema).load(f"{first}/{name}")
            stored.write.mode("overwrite").format(fmt).save(f"{root}/{name}")
        written.append(name)
    return written


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row count, xor and sum of row hashes."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(h).alias("hash_xor"),
        F.sum(h.cast("decimal(38,0)")).alias("hash_sum"),
    )


def verify_copies(spark: SparkSession, a: str, b: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """One row that says whether two written copies hold the same rows."""
    def load(path: str) -> DataFrame:
        reader = spark.read.format(fmt)
        return (reader.schema(schema) if schema is not None else reader).load(path)

    both = content_hash(load(a)).unionByName(content_hash(load(b)))
    distinct = F.count_distinct("rows", F.coalesce("hash_xor", F.lit(0)), F.coalesce("hash_sum", F.lit(0)))
    return both.agg(F.max("rows").alias("rows"), (distinct == 1).alias("same"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
