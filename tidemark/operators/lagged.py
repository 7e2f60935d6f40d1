"""Lag and lead pairing of an annual driver with outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.moments import correlation, pair_count
from tidemark.functions.scalars import col
from tidemark.operators.correlation import avg_rank

WINDOW_MONTHS = 12
WINDOW_MINIMUM = 9


def offsets(values) -> F.Column:
    """A fixed list of offsets, exploded beside each driver row."""
    return F.explode(F.array(*[F.lit(int(v)) for v in values]))


def lag_pairs(driver: DataFrame, outcomes: DataFrame, lags) -> DataFrame:
    """Driver at a date with each outcome exactly ``lag`` years later.

    ``driver(date, driver)``, ``outcomes(outcome_key, date, outcome)``; rows
    with a missing value on either side form no pair.
    """
    shifted = driver.where(F.col("driver").isNotNull()).select(
        F.col("date").alias("anchor"), "driver", offsets(lags).alias("lag")
    ).withColumn("date", F.add_months("anchor", F.col("lag") * 12))
    present = outcomes.where(F.col("outcome").isNotNull())
    return shifted.join(present, "date").select(
        "outcome_key", "lag", F.col("anchor").alias("date"), "driver", "outcome",
        F.year("anchor").cast("int").alias("year"),
    )


def monthly_compound(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Growth factor and row count per market and month, before any join."""
    return (
        returns.where(col(value).isNotNull())
        .groupBy("market", cal.period_index("date", "monthly").alias("month_idx"))
        .agg(F.product(col(value) + 1.0).alias("growth"), F.count(F.lit(1)).alias("rows"))
    )


def window_anchors(anchors: DataFrame, shifts, direction: str) -> DataFrame:
    """(anchor, direction, offset, first_month) of 12-month windows.

    ``forward`` windows start ``offset`` months after the anchor, ``backward``
    windows end ``offset`` months before it.
    """
    dates = anchors.select(F.col("date").alias("anchor")).distinct()
    base = dates.select("anchor", F.lit(direction).alias("direction"), offsets(shifts).alias("offset"))
    month = cal.period_index("anchor", "monthly")
    first = {
        "forward": month + F.col("offset") + 1,
        "backward": month - F.col("offset") - (WINDOW_MONTHS - 1),
    }[direction]
    return base.withColumn("first_month", first)


def window_return(anchors: DataFrame, returns: DataFrame, min_n: int = WINDOW_MINIMUM,
                  value: str = "ret") -> DataFrame:
    """Percent return compounded over each anchor's 12 months.

    Both window ends are month ends, so "after the start, up to the end" is
    exactly twelve whole months: the range join becomes an equi-join on the
    month index of monthly pre-aggregates.
    """
    last = F.col("first_month") + (WINDOW_MONTHS - 1)
    months = anchors.withColumn("month_idx", F.explode(F.sequence("first_month", last)))
    return (
        monthly_compound(returns, value)
        .join(months, "month_idx")
        .groupBy("market", "anchor", "direction", "offset")
        .agg(
            ((F.product("growth") - 1.0) * 100.0).alias("window_return"),
            F.sum("rows").alias("n"),
        )
        .where(F.col("n") >= min_n)
    )


def forward_window_return(anchors: DataFrame, returns: DataFrame, lags,
                          min_n: int = WINDOW_MINIMUM, value: str = "ret") -> DataFrame:
    """Percent return over the 12 months that start ``lag`` months after a date."""
    return window_return(window_anchors(anchors, lags, "forward"), returns, min_n, value)


def backward_window_return(anchors: DataFrame, returns: DataFrame, leads,
                           min_n: int = WINDOW_MINIMUM, value: str = "ret") -> DataFrame:
    """Percent return over the 12 months that end ``lead`` months before a date."""
    return window_return(window_anchors(anchors, leads, "backward"), returns, min_n, value)


def lag_correlations(pairs: DataFrame, keys, exclude_years=(), min_n: int = 3) -> DataFrame:
    """Pearson, Spearman and counts per key, and Pearson without some years.

    ``pairs`` carries the keys with driver, outcome and year; correlations need
    at least ``min_n`` pairs.
    """
    keys = list(keys)
    keep = ~F.col("year").isin(list(exclude_years)) if exclude_years else F.lit(True)
    ranked = pairs.withColumns({
        "_rx": avg_rank("driver", keys),
        "_ry": avg_rank("outcome", keys),
    })
    out = ranked.groupBy(*keys).agg(
        correlation("driver", "outcome").alias("pearson"),
        correlation("_rx", "_ry").alias("spearman"),
        F.count(F.lit(1)).alias("n"),
        correlation("driver", "outcome", keep).alias("pearson_excluding"),
        pair_count("driver", "outcome", keep).alias("n_excluding"),
    )
    gated = {
        name: F.when(F.col(count) >= min_n, F.col(name))
        for name, count in (("pearson", "n"), ("spearman", "n"), ("pearson_excluding", "n_excluding"))
    }
    return out.withColumns(gated)


def lag_ladder(driver: DataFrame, outcomes: DataFrame, lags=(0, 1, 2, 3),
               required: int = 8) -> DataFrame:
    """Distributed-lag table: one row per outcome and lag with its sample gate."""
    found = lag_correlations(lag_pairs(driver, outcomes, lags), ("outcome_key", "lag"))
    # A cell without any pair is published too, with n = 0 and its gate.
    cells = outcomes.select("outcome_key").distinct().withColumn(
        "lag", F.explode(F.array(*[F.lit(i) for i in lags])))
    table = cells.join(found, ["outcome_key", "lag"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    eligible = F.col("n") >= required
    return table.select(
        "outcome_key", "lag", "n", "pearson", "spearman",
        eligible.alias("eligible"),
        F.when(eligible, F.lit("associational")).otherwise("insufficient_data").alias("status"),
    )
