"""Vintage assembly, denominators and revision merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalars import col, pct, ratio

# How many years before its edition a snapshot column refers to.
SNAPSHOT_OFFSETS = {"current_budget_capex": 0, "prior_revised_capex": 1, "actual_capex": 2,
                    "actual_total_expenditure": 2}
SNAPSHOT_KINDS = {"current_budget_capex": "budget", "prior_revised_capex": "revised",
                  "actual_capex": "actual", "actual_total_expenditure": "total_expenditure"}


def snapshot_values(snapshots: DataFrame) -> DataFrame:
    """One row per (edition, fiscal year, kind, value)."""
    long = snapshots.unpivot(["edition"], list(SNAPSHOT_OFFSETS), "column", "value")
    back = F.when(F.col("column") == "current_budget_capex", 0).when(
        F.col("column") == "prior_revised_capex", 1
    ).otherwise(2)
    kind = F.lit(None).cast("string")
    for name, label in SNAPSHOT_KINDS.items():
        kind = F.when(F.col("column") == name, F.lit(label)).otherwise(kind)
    return long.select(
        "edition", (F.col("edition") - back).cast("int").alias("fy"), kind.alias("kind"), "value"
    )


def assemble_vintages(snapshots: DataFrame) -> DataFrame:
    """Budget, revised and actual per fiscal year; the newest edition wins.

    Pivoting the unpivoted snapshots is the full outer join of the three
    vintages, in a single grouped aggregation.
    """
    kinds = list(SNAPSHOT_KINDS.values())
    newest = snapshot_values(snapshots).groupBy("fy", "kind").agg(
        F.max_by("value", "edition").alias("value")
    )
    return newest.groupBy("fy").pivot("kind", kinds).agg(F.first("value", ignorenulls=True))


def execution_ratio(vintages: DataFrame) -> DataFrame:
    """Actual as percent of the original budget, where both exist."""
    both = F.col("actual").isNotNull() & F.col("budget").isNotNull()
    return vintages.where(both).select("fy", pct("actual", "budget").alias("execution_ratio"))


def with_denominator(df: DataFrame, dimension: DataFrame, on, value: str, denominator: str,
                     out: str) -> DataFrame:
    """Left lookup of a denominator; null where it is missing or not positive."""
    joined = df.join(dimension, on, "left")
    share = F.when(col(denominator) > 0, pct(value, denominator))
    return joined.withColumn(out, share)


def ratio_series(numerator: DataFrame, denominator: DataFrame, on="date", out: str = "value") -> DataFrame:
    """Percent ratio of two (key, value) series on their common keys."""
    on = [on] if isinstance(on, str) else list(on)
    a = numerator.select(*on, F.col("value").alias("_n"))
    b = denominator.select(*on, F.col("value").alias("_d"))
    return a.join(b, on).select(*on, pct("_n", "_d").alias(out))


def execution_records(vintages: DataFrame, gdp: DataFrame | None = None) -> DataFrame:
    """Vintage table as dated records (fy here is the fiscal START year)."""
    base = vintages.select(
        "*",
        cal.fy_end_date("fy").alias("date"),
        cal.fy_label("fy").alias("period_label"),
        pct("actual", "total_expenditure").alias("share"),
        F.when(F.col("budget").isNotNull(), pct("actual", "budget")).alias("execution"),
    )
    if gdp is not None:
        base = with_denominator(
            base, gdp.select("fy", F.col("value").alias("_gdp"), F.col("status").alias("_gdp_status")),
            "fy", "actual", "_gdp", "_gdp_share",
        )
    else:
        base = base.withColumns({
            "_gdp_share": F.lit(None).cast("double"), "_gdp_status": F.lit(None).cast("string"),
        })

    def entry(indicator: str, value: str, unit: str, status) -> F.Column:
        return F.struct(
            F.lit(indicator).alias("indicator"), F.col(value).alias("value"),
            F.lit(unit).alias("unit"), status.alias("status"),
        )

    has_actual = F.col("actual").isNotNull()
    entries = F.array(
        entry("capex_budget_estimate", "budget", "INR_crore", F.lit("budget")),
        entry("capex_revised_estimate", "revised", "INR_crore", F.lit("estimate")),
        entry("capex_actual", "actual", "INR_crore", F.lit("actual")),
        entry("actual_capex_pct_total_expenditure", "share", "percent", F.lit("actual")),
        entry("actual_capex_pct_gdp", "_gdp_share", "percent", F.col("_gdp_status")),
        entry("capex_execution_ratio", "execution", "percent", F.lit("actual")),
    )
    rows = base.select("date", "period_label", has_actual.alias("_has"), F.explode(entries).alias("e"))
    # A share is still reported, as null, when its own actual exists.
    kept = F.col("e.value").isNotNull() | (
        F.col("_has") & (F.col("e.indicator") == "actual_capex_pct_total_expenditure")
    )
    return rows.where(kept).select("date", F.lit("IND").alias("entity"), "e.*", "period_label")


def bridge(left: DataFrame, right: DataFrame, ratio_indicator: str, by=()) -> DataFrame:
    """All left rows, plus left/right ratio rows where the right is usable.

    Both sides are (*by, date, indicator, value, status).  A ratio takes the right
    status unless that is "actual", then the left one.
    """
    r = right.where("value is not null").select(
        *by, "date", F.col("value").alias("_rv"), F.col("status").alias("_rs")
    )
    joined = left.join(r, [*by, "date"], "left")
    derived = F.when(
        F.col("value").isNotNull() & (F.col("_rv") != 0),
        F.struct(
            F.lit(ratio_indicator).alias("indicator"),
            ratio("value", "_rv").alias("value"),
            F.when(F.col("_rs") != "actual", F.col("_rs")).otherwise(F.col("status")).alias("status"),
        ),
    )
    own = F.struct("indicator", "value", "status")
    rows = joined.select(*by, "date", F.explode(F.array(own, derived)).alias("e"))
    return rows.where("e is not null").select(*by, "date", "e.*")


def quality_join(status: DataFrame, cost: DataFrame, keys=("sector", "year")) -> DataFrame:
    """Full outer join of delivery counts and cost rows per sector and year."""
    return status.join(cost, list(keys), "full_outer")


def upsert_latest(archive: DataFrame, batch: DataFrame, keys, ts: str) -> DataFrame:
    """Newest revision per key; on equal times the batch replaces the archive."""
    keys = list(keys)
    marked = archive.withColumn("_batch", F.lit(0)).unionByName(batch.withColumn("_batch", F.lit(1)))
    rest = [c for c in archive.columns if c not in keys]
    order = F.struct(col(ts), F.col("_batch"), F.xxhash64(*rest))
    newest = marked.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def prefer_source(base: DataFrame, override: DataFrame, keys) -> DataFrame:
    """Override rows replace base rows of the same key; the rest is kept."""
    keys = list(keys)
    rest = [c for c in base.columns if c not in keys]
    replaced = override.select(*keys, F.struct(*rest).alias("_new"))
    joined = base.select(*keys, F.struct(*rest).alias("_old")).join(replaced, keys, "full_outer")
    chosen = F.when(F.col("_new").isNotNull(), F.col("_new")).otherwise(F.col("_old"))
    return joined.withColumn("_row", chosen).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def convert_currency(df: DataFrame, rates: DataFrame, value: str = "value",
                     currency: str = "currency", out: str = "usd") -> DataFrame:
    """Value over the latest rate of its currency; USD stays as it is."""
    latest = rates.where("rate is not null").groupBy(currency).agg(
        F.max_by("rate", "date").alias("_rate")
    )
    joined = df.join(latest, currency, "left")
    converted = F.when(col(currency) == "USD", col(value)).otherwise(ratio(value, "_rate"))
    return joined.withColumn(out, converted).drop("_rate")
