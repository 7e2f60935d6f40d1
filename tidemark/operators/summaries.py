"""Grouped summaries (A2-A8, A43-A49 and related projections).

All of these are plain grouped aggregates with map-side partials, so a key
holding a large share of the rows shrinks before the exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import calendar as cal
from tidemark.functions.scalars import col, finite, offset_ratio, pct, predict_debt
from tidemark.operators.filters import settled
from tidemark.operators.growth import trailing_consecutive_sum
from tidemark.session import settle

FLOW_CATEGORIES = ("DII", "FPI")


def monthly_flows(flows: DataFrame, categories=FLOW_CATEGORIES) -> DataFrame:
    """Net flow per month and category, dated at the month's last flow date."""
    sums = {c: F.coalesce(F.sum(F.when(F.col("category") == c, F.col("net"))), F.lit(0.0))
            for c in categories}
    known = flows.where(F.col("category").isin(*categories))
    return known.groupBy(F.trunc("date", "month").alias("month")).agg(
        F.max("date").alias("date"), *[v.alias(c) for c, v in sums.items()]
    )


def capital_resilience(monthly: DataFrame, months: int = 12) -> DataFrame:
    """Trailing sums over consecutive months and the offset ratio."""
    staged = trailing_consecutive_sum(monthly, months, "DII", out="dii_rolling_12m")
    staged = trailing_consecutive_sum(staged, months, "FPI", out="fpi_rolling_12m")
    return staged.withColumn("dii_offset_ratio", offset_ratio("DII", "FPI"))


def fiscalise(df: DataFrame, value: str = "value", keys=(), date: str = "date") -> DataFrame:
    """Mean of the observations of each fiscal year, dated 31 March."""
    year = cal.fy_end(date)
    out = df.where(col(value).isNotNull()).groupBy(*keys, year.alias("fy")).agg(
        F.avg(col(value)).alias(value)
    )
    return out.withColumn("date", F.make_date("fy", F.lit(3), F.lit(31)))


def median_bucket(value: Column, per_unit: float = 200.0, floor: float = 1e-6) -> Column:
    """A non-decreasing integer of a value, about half a percent wide."""
    size = F.ln(F.abs(value) / floor + 1.0) * per_unit
    return F.floor(F.signum(value) * size).cast("long")


def exact_median(df: DataFrame, value: str, keys, out: str = "median") -> DataFrame:
    """Exact median per group without gathering a group.

    Counts per narrow value range find the range that holds the middle; only
    that range's distinct values are then ordered.
    """
    keys = list(keys)
    # Read once for the ranges and once for the chosen one.
    counts = settle(df.where(col(value).isNotNull()).groupBy(*keys, col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c")
    ).withColumn("_b", median_bucket(F.col("_v"))))
    group = W.partitionBy(*keys)
    upto = group.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    ranges = counts.groupBy(*keys, "_b").agg(F.sum("_c").alias("_c")).select(
        *keys, "_b", F.sum("_c").over(upto).alias("_end"),
        (F.sum("_c").over(upto) - F.col("_c")).alias("_start"), F.sum("_c").over(group).alias("_n"),
    )
    # The one or two middle ranks, counted from 1.
    low, high = F.expr("(_n + 1) div 2"), F.expr("(_n + 2) div 2")
    middle = ranges.where((F.col("_start") < high) & (F.col("_end") >= low))
    inside = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.join(middle.drop("_end"), [*keys, "_b"]).withColumn(
        "_to", F.col("_start") + F.sum("_c").over(inside)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_to") - F.col("_c") < rank) & (F.col("_to") >= rank), F.col("_v")))

    return ranked.groupBy(*keys).agg(((at(low) + at(high)) / 2.0).alias(out))


def group_median(df: DataFrame, metric: str, keys=("grp", "fy")) -> DataFrame:
    """Unweighted median of the finite values per group."""
    return exact_median(df.withColumn("_x", finite(metric)), "_x", keys, f"median_{metric}")


def coverage(df: DataFrame, keys, label: str, year: str) -> DataFrame:
    """First label, year range and row count per key.

    The label is the one of the earliest year, smallest label on ties.
    """
    return df.groupBy(*keys).agg(
        F.min_by(col(label), F.struct(col(year), col(label))).alias(label),
        F.min(col(year)).alias("start_year"),
        F.max(col(year)).alias("end_year"),
        F.count(F.lit(1)).alias("observations"),
    )


def delivery_quality(df: DataFrame) -> DataFrame:
    """Delivery shares and cost overrun from joined status and cost rows."""
    parts = ("ahead", "on_schedule", "delayed", "without_date")
    filled = {p: F.coalesce(col(p), F.lit(0)) for p in parts}
    monitored = filled["ahead"] + filled["on_schedule"] + filled["delayed"] + filled["without_date"]
    return df.select(
        "sector", "year",
        F.when(monitored != 0, monitored).alias("projects_monitored"),
        pct(filled["ahead"] + filled["on_schedule"], monitored).alias("on_schedule_share"),
        pct(filled["delayed"], monitored).alias("delayed_share"),
        pct(filled["without_date"], monitored).alias("without_date_share"),
        "original_cost", "anticipated_cost", "cost_overrun",
        pct("cost_overrun", "original_cost").alias("cost_overrun_pct"),
    )


def to_quarter(df: DataFrame, how: str = "mean", keys=(), value: str = "value",
               date: str = "date") -> DataFrame:
    """Monthly rows to quarters with all three months present.

    ``complete`` is false for the quarters that must be left out, so callers
    can count them; status is the one of the last row.
    """
    last = F.max_by(col(value), col(date))
    stat = {"mean": F.avg(col(value)), "sum": F.sum(col(value)), "last": last}[how]
    grouped = df.groupBy(
        *keys, F.year(col(date)).alias("_y"), F.quarter(col(date)).alias("_q")
    ).agg(
        stat.alias(value),
        F.max_by("status", col(date)).alias("status"),
        F.max("source_date").alias("source_date"),
        (F.count_distinct(F.month(col(date))) == 3).alias("complete"),
    )
    return grouped.withColumn(date, cal.quarter_end("_y", "_q")).drop("_y", "_q")


def exclusion_summary(reasons: DataFrame, by=()) -> DataFrame:
    """Rows per input and exclusion reason, within ``by``."""
    return reasons.where("reason is not null").groupBy(*by, "input", "reason").agg(
        F.count(F.lit(1)).alias("n")
    )


def backtest(debt: DataFrame, balance: DataFrame, interest_pct: float, growth_pct: float) -> DataFrame:
    """One-step debt predictions for settled years against what happened."""
    w = W.orderBy("date")
    known = settled(debt).where("value is not null").select(
        "date", F.col("value").alias("actual"), F.lag("value").over(w).alias("previous")
    )
    b = balance.where("value is not null").select("date", F.col("value").alias("balance"))
    return known.where("previous is not null").join(b, "date").select(
        "date", "actual",
        predict_debt("previous", "balance", interest_pct, growth_pct).alias("predicted"),
    ).withColumn("error", F.col("predicted") - F.col("actual"))


def backtest_errors(rows: DataFrame, last: int = 10) -> DataFrame:
    """Mean absolute and root mean squared error of the last predictions."""
    recent = rows.orderBy(F.col("date").desc()).limit(last)
    return recent.agg(
        F.coalesce(F.avg(F.abs("error")), F.lit(0.0)).alias("mae"),
        F.coalesce(F.sqrt(F.avg(F.col("error") * F.col("error"))), F.lit(0.0)).alias("rmse"),
        F.count(F.lit(1)).alias("n"),
    )


def inventory(outputs: DataFrame) -> DataFrame:
    """Series and observation counts with date coverage per output."""
    return outputs.groupBy("output").agg(
        F.count_distinct("series").alias("series"),
        F.count(F.lit(1)).alias("observations"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
    )


def non_null_counts(wide: DataFrame, columns) -> DataFrame:
    """Non-null values per column of a wide frame, as long rows."""
    counted = wide.agg(*[F.count(col(c)).alias(c) for c in columns])
    return counted.unpivot([], list(columns), "series", "n")


def scatter_points(x: DataFrame, y: DataFrame, z: DataFrame | None = None, on="date") -> DataFrame:
    """Matched points of two series, a third one optional; ``on`` is the date, or entity and date."""
    keys = [on] if isinstance(on, str) else list(on)
    a = x.where("value is not null").select(*keys, F.col("value").alias("x"))
    b = y.where("value is not null").select(*keys, F.col("value").alias("y"))
    points = a.join(b, keys)
    if z is not None:
        points = points.join(z.select(*keys, F.col("value").alias("z")), keys, "left")
    return points


def scatter_reference(points: DataFrame, by=()) -> DataFrame:
    """Median lines of x and y, range of z, within ``by``; no task gathers the values."""
    spread = points.groupBy(*by).agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"))
    if not by:
        x, y = (exact_median(points, c, ()).scalar() for c in ("x", "y"))
        return spread.select(x.alias("median_x"), y.alias("median_y"), "min_z", "max_z")
    for c in ("x", "y"):
        middle = exact_median(points, c, by)
        spread = spread.join(middle.withColumnRenamed(middle.columns[-1], f"median_{c}"), list(by), "left")
    return spread.select(*by, "median_x", "median_y", "min_z", "max_z")
