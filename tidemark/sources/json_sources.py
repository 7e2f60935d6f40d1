"""JSON scans with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions.scalars import col
from tidemark.schema import ANNUAL_DATASET, PRICE_MATRIX, STATUSES


def read_price_matrix(spark: SparkSession, path) -> DataFrame:
    """Column-oriented price files to long prices; missing cells are dropped."""
    raw = spark.read.schema(PRICE_MATRIX).json(path, multiLine=True)
    columns = raw.select("dates", F.explode("values").alias("market", "column"))
    cells = columns.select("dates", "market", F.posexplode("column").alias("pos", "price"))
    return cells.select(
        F.to_date(F.get("dates", "pos")).alias("date"), "market", "price"
    ).where("price is not null and date is not null")


def read_landed(spark: SparkSession, path, observation: T.StructType,
                envelope: T.StructType | None = None) -> DataFrame:
    """Landed envelopes (one JSON object with observations[]) to rows.

    File path and modification time stay with each row as provenance.
    """
    fields = list(envelope.fields) if envelope else [T.StructField("key", T.StringType()),
                                                     T.StructField("retrieved_at", T.StringType())]
    schema = T.StructType([*fields, T.StructField("observations", T.ArrayType(observation))])
    raw = spark.read.schema(schema).json(path)
    return raw.select(
        *[f.name for f in fields],
        F.explode("observations").alias("o"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_modification_time").alias("file_time"),
    ).select(*[f.name for f in fields], "o.*", "file_path", "file_time")


FISCAL_PERIOD = r"^(\d{4})-(\d{2})$"


def annual_reference_rows(raw: DataFrame) -> DataFrame:
    """(dataset, series, period, fy, value, status) from nested annual objects.

    ``raw`` has one map column ``datasets``; ``fy`` is the fiscal END year.
    """
    series = raw.select(F.explode("datasets").alias("dataset", "d")).select(
        "dataset", F.explode("d.series").alias("series", "s")
    )
    rows = series.select(
        "dataset", "series", F.col("s.status").alias("status"),
        F.posexplode("s.observations").alias("pos", "period", "text"),
    )
    start = F.regexp_extract("period", FISCAL_PERIOD, 1).try_cast("int")
    return rows.select(
        "dataset", "series", "pos", "period", (start + 1).cast("int").alias("fy"),
        F.col("text").try_cast("double").alias("value"), "status",
    )


def read_annual_reference(spark: SparkSession, path) -> DataFrame:
    schema = T.MapType(T.StringType(), ANNUAL_DATASET)
    text = spark.read.text(path, wholetext=True)
    return annual_reference_rows(text.select(F.from_json("value", schema).alias("datasets")))


def annual_reference_violations(rows: DataFrame) -> DataFrame:
    """Malformed periods, non-finite values, unknown status, broken order."""
    suffix = F.regexp_extract("period", FISCAL_PERIOD, 2).try_cast("int")
    bad_period = F.coalesce(suffix != F.pmod("fy", F.lit(100)), F.lit(True))
    bad_value = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    w = W.partitionBy("dataset", "series").orderBy("pos")
    unordered = F.coalesce(F.col("period") <= F.lag("period").over(w), F.lit(False))
    problem = (
        F.when(bad_period, F.lit("period")).when(bad_value, F.lit("value"))
        .when(~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), F.lit("status"))
        .when(unordered, F.lit("order"))
    )
    return rows.withColumn("problem", problem).where("problem is not null")


API_ROW = T.StructType([
    T.StructField("country", T.StringType()), T.StructField("indicator", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("value", T.DoubleType()),
])


def normalize_country_payload(df: DataFrame, rows: str = "rows") -> DataFrame:
    """API rows of annual text years to records dated 31 December.

    Rows with a missing value or a year that is not a number are dropped.
    """
    flat = df.select(F.explode(rows).alias("r")).select("r.*")
    year = F.col("date").try_cast("int")
    return flat.where(year.isNotNull() & F.col("value").isNotNull()).select(
        F.make_date(year, F.lit(12), F.lit(31)).alias("date"),
        F.col("country").alias("entity"), "indicator", year.alias("year"), "value",
    )


def parse_payload(df: DataFrame, text: str = "payload") -> DataFrame:
    """The two-element API payload [meta, rows[]] kept as text."""
    rows = F.from_json(F.get_json_object(col(text), "$[1]"), T.ArrayType(API_ROW))
    return df.withColumn("rows", rows)


def year_values(df: DataFrame) -> DataFrame:
    """Year to value lookup, nulls dropped."""
    return df.where("value is not null").select("entity", "year", "value")
