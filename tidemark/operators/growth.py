"""Lags, changes and trailing windows.

Three lag rules are kept apart: positional (previous row), calendar (exactly
the previous period) and previous non-null value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import calendar as cal
from tidemark.functions.scalars import change, col, least_final


def series_window(keys=(), order: str = "date"):
    return W.partitionBy(*[col(k) for k in keys]).orderBy(col(order))


def trailing(keys, order: str, n: int):
    return series_window(keys, order).rowsBetween(-(n - 1), 0)


def pct_change(df: DataFrame, value: str = "price", keys=("market",), order: str = "date",
               out: str = "ret", scale: float = 1.0) -> DataFrame:
    """Change against the previous row, null when either side is null."""
    previous = F.lag(col(value)).over(series_window(keys, order))
    return df.withColumn(out, change(value, previous) * scale)


def pct_change_on_grid(prices: DataFrame, keys=("market",), value: str = "price",
                       out: str = "ret") -> DataFrame:
    """Change against the previous date of the union calendar of all series.

    A series without a row on that previous date gets null, as if the long
    frame were a wide one with missing cells.  The calendar holds one row per
    distinct date.
    """
    calendar = prices.select("date").distinct().withColumn(
        "_pos", F.row_number().over(W.orderBy("date"))
    )
    w = series_window(keys, "_pos").rangeBetween(-1, -1)
    return (
        prices.join(calendar, "date")
        .withColumn(out, change(value, F.first(col(value)).over(w)))
        .drop("_pos")
    )


def growth_prev_nonnull(df: DataFrame, value: str = "value", keys=("entity", "indicator"),
                        order: str = "date", out: str = "growth") -> DataFrame:
    """Percent change against the latest earlier non-null value."""
    w = series_window(keys, order).rowsBetween(W.unboundedPreceding, -1)
    previous = F.last(col(value), ignorenulls=True).over(w)
    return df.withColumn(out, change(value, previous) * 100.0)


def at_period(value, index: str, keys, offset: int) -> Column:
    """The value exactly ``offset`` periods away, null when absent."""
    w = series_window(keys, index).rangeBetween(offset, offset)
    return F.first(col(value)).over(w)


def period_diff(df: DataFrame, frequency: str, value: str = "value", keys=(), log: bool = False,
                out: str = "diff", date: str = "date") -> DataFrame:
    """Difference to exactly the previous period, optionally of logarithms."""
    v = F.when(col(value) > 0, F.ln(col(value))) if log else col(value)
    staged = df.withColumn("_idx", cal.period_index(date, frequency)).withColumn("_v", v)
    return staged.withColumn(out, F.col("_v") - at_period("_v", "_idx", keys, -1)).drop("_idx", "_v")


def yoy_exact(df: DataFrame, value: str = "value", keys=(), date: str = "date",
              out: str = "yoy") -> DataFrame:
    """Percent change to the same month a year ago; only where that exists."""
    staged = df.withColumn("_idx", cal.period_index(date, "monthly"))
    grown = staged.withColumn(out, change(value, at_period(value, "_idx", keys, -12)) * 100.0)
    return grown.where(col(out).isNotNull()).drop("_idx")


def lead_year_growth(df: DataFrame, value: str = "constant_value", keys=("state",),
                     year: str = "fy", out: str = "next_growth") -> DataFrame:
    """Percent growth into the following year, null when that year is absent."""
    ahead = at_period(value, year, keys, 1)
    return df.withColumn(out, change(ahead, value) * 100.0)


def shift_fiscal_year(df: DataFrame, out_indicator: str) -> DataFrame:
    """Re-date an indicator one fiscal year later, value and status kept."""
    moved = F.last_day(F.add_months("date", 12))
    start_year = cal.fy_start(moved)
    return df.withColumns({
        "date": moved,
        "indicator": F.lit(out_indicator),
        "period_label": cal.fy_label(start_year),
        "period_start": cal.fy_start_date(start_year),
        "period_end": moved,
        "is_derived": F.lit(True),
    })


def trailing_deviation(df: DataFrame, n: int = 60, value: str = "value", keys=(),
                       order: str = "date", out: str = "deviation") -> DataFrame:
    """Percent deviation from the mean of the last ``n`` rows, this one included."""
    w = trailing(keys, order, n)
    mean = F.when(F.count(col(value)).over(w) == n, F.avg(col(value)).over(w))
    return df.withColumn(out, change(value, mean) * 100.0)


def trailing_consecutive_sum(df: DataFrame, n: int = 12, value: str = "value", keys=(),
                             date: str = "date", out: str = "trailing_sum") -> DataFrame:
    """Sum of the last ``n`` months, only if they are consecutive months."""
    staged = df.withColumn("_idx", cal.period_index(date, "monthly"))
    w = trailing(keys, "_idx", n)
    whole = (F.count(F.lit(1)).over(w) == n) & (
        F.col("_idx") - F.min("_idx").over(w) == n - 1
    )
    return staged.withColumn(out, F.when(whole, F.sum(col(value)).over(w))).drop("_idx")


def growth_gap(left: DataFrame, right: DataFrame, year: str = "year",
               out: str = "gap") -> DataFrame:
    """Growth of one level minus growth of another, all four levels required.

    Both inputs carry (year, value, status); a non-positive level is an error.
    """
    def grown(df: DataFrame, name: str) -> DataFrame:
        level = F.when(F.col("value") > 0, F.col("value")).otherwise(
            F.raise_error(F.lit("Levels of a growth gap must be positive")).cast("double")
        )
        staged = df.select(col(year), level.alias("_v"), F.col("status").alias(f"{name}_status"))
        return staged.withColumn(
            f"{name}_growth", change("_v", at_period("_v", year, (), -1)) * 100.0
        ).drop("_v")

    joined = grown(left, "left").join(grown(right, "right"), year)
    complete = F.col("left_growth").isNotNull() & F.col("right_growth").isNotNull()
    return joined.where(complete).select(
        col(year),
        "left_growth",
        "right_growth",
        (F.col("left_growth") - F.col("right_growth")).alias(out),
        least_final("left_status", "right_status").alias("status"),
    )
