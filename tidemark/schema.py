"""Explicit schemas and closed value domains."""

from __future__ import annotations

from pyspark.sql import types as T

# Observation status domain, most final first; the order is the severity order.
STATUSES = ("actual", "revised", "provisional", "estimate", "budget")
SETTLED_EXCLUDES = ("budget", "estimate")

# Age in days after which an output of this frequency is stale.
STALE_AFTER_DAYS = {"monthly": 45, "annual": 450, "mixed": 120}
STALE_AFTER_DEFAULT = 120

RECORDS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("entity", T.StringType()),
    T.StructField("indicator", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("frequency", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("period_label", T.StringType()),
    T.StructField("is_derived", T.BooleanType()),
    T.StructField("method", T.StringType()),
    T.StructField("source_url", T.StringType()),
    T.StructField("retrieved_at", T.TimestampType()),
    T.StructField("vintage", T.StringType()),
    T.StructField("period_start", T.DateType()),
    T.StructField("period_end", T.DateType()),
])
FLOWS = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField("category", T.StringType()),
    T.StructField("buy", T.DoubleType()),
    T.StructField("sell", T.DoubleType()),
    T.StructField("net", T.DoubleType()),
])

SNAPSHOTS = T.StructType([
    T.StructField("edition", T.IntegerType()),
    T.StructField("actual_capex", T.DoubleType()),
    T.StructField("prior_budget_capex", T.DoubleType()),
    T.StructField("prior_revised_capex", T.DoubleType()),
    T.StructField("current_budget_capex", T.DoubleType()),
    T.StructField("actual_total_expenditure", T.DoubleType()),
])

# A column-oriented price file: dates[] beside values{market: [...]}.
PRICE_MATRIX = T.StructType([
    T.StructField("dates", T.ArrayType(T.StringType())),
    T.StructField("values", T.MapType(T.StringType(), T.ArrayType(T.DoubleType()))),
])

# A nested annual reference file: dataset -> {series -> {status, observations}}.
ANNUAL_SERIES = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("observations", T.MapType(T.StringType(), T.StringType())),
])
ANNUAL_DATASET = T.StructType([
    T.StructField("series", T.MapType(T.StringType(), ANNUAL_SERIES)),
])

GRID = T.StructType([
    T.StructField("sheet_id", T.StringType()),
    T.StructField("row_no", T.IntegerType()),
    T.StructField("cells", T.ArrayType(T.StringType())),
])
