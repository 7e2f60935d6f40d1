"""Returns, risk and performance of price series.

Inputs are long frames ``prices(date, market, price)`` with one row per market
and date.  ``month_last`` turns any finer history into monthly rows by partial
aggregation before a window sees it.
(A1, A9-A19, J11, J17, J23, T4, W6-W9, W11, W12, W17, W18)
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.moments import full_window
from tidemark.functions.scalars import change, col, ratio
from tidemark.operators.filters import common_period, drop_any
from tidemark.operators.growth import pct_change, series_window, trailing
from tidemark.operators.ranks import numbered

TRADING_DAYS = 252
MONTHS = 12


def month_last(prices: DataFrame, value: str = "price", market: str = "market") -> DataFrame:
    """Last non-null value per month, dated at the last observed date."""
    return (
        prices.where(col(value).isNotNull())
        .groupBy(col(market), F.trunc("date", "month").alias("month"))
        .agg(F.max_by(col(value), col("date")).alias(value), F.max("date").alias("date"))
        .select("date", col(market), col(value), "month")
    )


def with_returns(prices: DataFrame, keys=("market",)) -> DataFrame:
    return pct_change(prices, "price", keys, "date", "ret")


# --- series ---------------------------------------------------------------

def running(keys=("market",), order: str = "date"):
    return series_window(keys, order).rowsBetween(W.unboundedPreceding, 0)


def rebase(df: DataFrame, base: float = 100.0, value: str = "price", keys=("market",),
           out: str = "rebased") -> DataFrame:
    """Level relative to the first row of its series, times ``base``."""
    return df.withColumn(out, ratio(value, F.first(col(value)).over(running(keys))) * base)


def drawdown(df: DataFrame, value: str = "price", keys=("market",), out: str = "drawdown") -> DataFrame:
    """Relative distance to the running maximum."""
    return df.withColumn(out, change(value, F.max(col(value)).over(running(keys))))


def with_benchmark(df: DataFrame, benchmark: str, value: str = "ret", out: str = "bench") -> DataFrame:
    """Benchmark value of the same date beside every row.

    A window by date costs one exchange of already aggregated rows; joining a
    filtered copy would read the source twice.
    """
    same_date = W.partitionBy("date")
    return df.withColumn(out, F.max(F.when(F.col("market") == benchmark, col(value))).over(same_date))


def excess_return(df: DataFrame, benchmark: str, value: str = "ret", out: str = "excess") -> DataFrame:
    """Return minus the benchmark's; the benchmark itself is 0 on every row."""
    staged = with_benchmark(df, benchmark, value, "_bench")
    return staged.withColumn(
        out,
        F.when(F.col("market") == benchmark, F.lit(0.0)).otherwise(col(value) - F.col("_bench")),
    ).drop("_bench")


def relative_wealth(df: DataFrame, benchmark: str, value: str = "ret", out: str = "relative") -> DataFrame:
    """Cumulative product of (1+r)/(1+b) times 100; the benchmark stays at 100.

    Rows without both returns do not move the product and stay null.
    """
    staged = with_benchmark(df, benchmark, value, "_bench")
    step = ratio(col(value) + 1.0, F.col("_bench") + 1.0)
    wealth = F.when(step.isNotNull(), F.product(step).over(running()) * 100.0)
    return staged.withColumn(
        out, F.when(F.col("market") == benchmark, F.lit(100.0)).otherwise(wealth)
    ).drop("_bench")


def rolling_sum(df: DataFrame, value: str, n: int, keys=("market",), out: str = "rolling_sum") -> DataFrame:
    w = trailing(keys, "date", n)
    return df.withColumn(out, full_window(value, n, w, F.sum(col(value)).over(w)))


def rolling_volatility(df: DataFrame, value: str = "ret", n: int = TRADING_DAYS, keys=("market",),
                       periods: int = TRADING_DAYS, out: str = "rolling_volatility") -> DataFrame:
    w = trailing(keys, "date", n)
    deviation = F.stddev_samp(col(value)).over(w) * math.sqrt(periods)
    return df.withColumn(out, full_window(value, n, w, deviation))


def rolling_return(df: DataFrame, value: str = "ret", n: int = TRADING_DAYS, keys=("market",),
                   out: str = "rolling_return") -> DataFrame:
    """Compounded return of the last ``n`` rows."""
    w = trailing(keys, "date", n)
    return df.withColumn(
        out, full_window(value, n, w, F.product(col(value) + 1.0).over(w) - 1.0)
    )


def rolling_sharpe(df: DataFrame, value: str = "ret", n: int = TRADING_DAYS, keys=("market",),
                   periods: int = TRADING_DAYS, out: str = "rolling_sharpe") -> DataFrame:
    w = trailing(keys, "date", n)
    sharpe = ratio(
        F.avg(col(value)).over(w) * periods,
        F.stddev_samp(col(value)).over(w) * math.sqrt(periods),
    )
    return df.withColumn(out, full_window(value, n, w, sharpe))


# --- aggregates ---------------------------------------------------------------

def first_value(value="price", order="date") -> Column:
    return F.min_by(col(value), col(order))


def last_value(value="price", order="date") -> Column:
    return F.max_by(col(value), col(order))


def cagr_expr(years: Column, value="price", order="date") -> Column:
    growth = ratio(last_value(value, order), first_value(value, order))
    return F.pow(growth, ratio(F.lit(1.0), years)) - 1.0


def cagr_years(basis: str, value="price", ret="ret") -> Column:
    """Length of the history in years under the three day-count rules."""
    if basis == "returns":
        return F.greatest(F.count(col(ret)) / F.lit(float(MONTHS)), F.lit(1.0 / MONTHS))
    if basis == "rows":
        return F.count(col(value)) / F.lit(float(TRADING_DAYS))
    if basis == "rows_floored":
        return F.greatest(
            F.count(col(value)) / F.lit(float(TRADING_DAYS)), F.lit(1.0 / TRADING_DAYS)
        )
    raise ValueError(f"Unknown day-count basis: {basis}")


def volatility_expr(ret="ret", periods: int = TRADING_DAYS) -> Column:
    return F.stddev_samp(col(ret)) * math.sqrt(periods)


def sharpe_expr(ret="ret", risk_free: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    excess = F.avg(col(ret)) - risk_free / periods
    return ratio(excess, F.stddev_samp(col(ret))) * math.sqrt(periods)


def downside_expr(ret="ret", periods: int = TRADING_DAYS) -> Column:
    """Deviation of the negative returns; 0 without any, null with one."""
    negative = F.when(col(ret) < 0, col(ret))
    return F.when(F.count(negative) == 0, F.lit(0.0)).otherwise(
        F.stddev_samp(negative) * math.sqrt(periods)
    )


def sortino_expr(ret="ret", risk_free: float = 0.0, periods: int = TRADING_DAYS) -> Column:
    down = downside_expr(ret, periods)
    return F.when(down == 0, F.lit(0.0)).otherwise(
        ratio(F.avg(col(ret)) * periods - risk_free, down)
    )


def _by_market(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.groupBy("market").agg(value.alias(name))


def total_return(prices: DataFrame) -> DataFrame:
    return _by_market(prices, "total_return", ratio(last_value(), first_value()) - 1.0)


def cagr(prices: DataFrame, basis: str = "rows") -> DataFrame:
    staged = with_returns(prices) if basis == "returns" else prices
    return _by_market(staged, "cagr", cagr_expr(cagr_years(basis)))


def annual_return(returns: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    return _by_market(returns, "annual_return", F.avg("ret") * periods)


def annual_volatility(returns: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    return _by_market(returns, "annual_volatility", volatility_expr("ret", periods))


def volatility_table(prices: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    """Annualised volatility in percent, highest first.

    Returns are taken on complete dates only: a wide frame drops any row with a
    missing cell after differencing.
    """
    returns = drop_any(with_returns(prices), value="ret")
    table = _by_market(returns, "volatility_pct", volatility_expr("ret", periods) * 100.0)
    return table.orderBy(F.col("volatility_pct").desc_nulls_last(), "market")


def sharpe(returns: DataFrame, risk_free: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    return _by_market(returns, "sharpe", sharpe_expr("ret", risk_free, periods))


def downside_volatility(returns: DataFrame, periods: int = TRADING_DAYS) -> DataFrame:
    return _by_market(returns, "downside_volatility", downside_expr("ret", periods))


def sortino(returns: DataFrame, risk_free: float = 0.0, periods: int = TRADING_DAYS) -> DataFrame:
    return _by_market(returns, "sortino", sortino_expr("ret", risk_free, periods))


def max_drawdown(prices: DataFrame, value: str = "price") -> DataFrame:
    return _by_market(drawdown(prices, value), "max_drawdown", F.min("drawdown"))


def calmar_expr(basis: str = "rows") -> Column:
    depth = F.abs(F.min("drawdown"))
    return F.when(depth == 0, F.lit(0.0)).otherwise(ratio(cagr_expr(cagr_years(basis)), depth))


def calmar(prices: DataFrame, basis: str = "rows") -> DataFrame:
    return _by_market(drawdown(prices), "calmar", calmar_expr(basis))


def risk_table(prices: DataFrame, periods: int = TRADING_DAYS, risk_free: float = 0.0) -> DataFrame:
    """All per-market return and risk measures from one pass over the series."""
    staged = drawdown(with_returns(prices))
    return staged.groupBy("market").agg(
        (ratio(last_value(), first_value()) - 1.0).alias("total_return"),
        cagr_expr(cagr_years("rows")).alias("cagr"),
        (F.avg("ret") * periods).alias("annual_return"),
        volatility_expr("ret", periods).alias("annual_volatility"),
        sharpe_expr("ret", risk_free, periods).alias("sharpe_ratio"),
        sortino_expr("ret", risk_free, periods).alias("sortino_ratio"),
        F.min("drawdown").alias("max_drawdown"),
        calmar_expr("rows").alias("calmar_ratio"),
    )


LOWER_IS_BETTER = frozenset({"annual_volatility"})


def metric_rankings(summary: DataFrame, metrics, market: str = "market") -> DataFrame:
    """Rank markets per metric; only volatility ranks ascending."""
    long = summary.unpivot([market], list(metrics), "metric", "value").where("value is not null")
    signed = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value")).otherwise(-F.col("value"))
    placed = numbered(long, ["metric"], [signed, market], "rank")
    return placed.withColumn("rank", F.col("rank").cast("int"))


# --- composed monthly performance ------------------------------------------

def sector_performance(prices: DataFrame, benchmark: str, required) -> DataFrame:
    """Monthly price, normalised level, relative wealth and rolling excess.

    Refuses a required market without prices, and fewer than 13 common months.
    """
    monthly = month_last(common_period(prices, required, check=True)).drop("month")
    months = monthly.select(F.count_distinct("date")).scalar()
    monthly = monthly.where(F.when(months > MONTHS, F.lit(True)).otherwise(
        F.raise_error(F.lit("At least 13 common months are required")).cast("boolean")))
    staged = with_benchmark(with_returns(monthly), benchmark)
    is_bench = F.col("market") == benchmark
    step = ratio(F.col("ret") + 1.0, F.col("bench") + 1.0)
    staged = staged.withColumns({
        "normalized_value": ratio("price", F.first("price").over(running())) * 100.0,
        "excess": F.when(is_bench, F.lit(0.0)).otherwise(F.col("ret") - F.col("bench")),
        "relative": F.when(is_bench, F.lit(100.0)).otherwise(
            F.when(step.isNotNull(), F.product(step).over(running()) * 100.0)
        ),
    })
    w12 = trailing(("market",), "date", MONTHS)
    return staged.select(
        "date", "market", "price", "normalized_value", "relative", "excess",
        F.col("ret").alias("raw_return"),
        change("relative", F.max("relative").over(running())).alias("drawdown"),
        full_window("excess", MONTHS, w12, F.stddev_samp("excess").over(w12) * math.sqrt(MONTHS))
        .alias("rolling_volatility"),
        full_window("excess", MONTHS, w12, F.sum("excess").over(w12)).alias("rolling_12m_excess"),
    )


def market_summary(performance: DataFrame) -> DataFrame:
    """One row of return and risk per market from ``sector_performance`` rows."""
    staged = performance.withColumn(
        "price_drawdown", change("price", F.max("price").over(running()))
    )
    return staged.groupBy("market").agg(
        (ratio(last_value(), first_value()) - 1.0).alias("total_return"),
        cagr_expr(cagr_years("returns", ret="raw_return")).alias("cagr"),
        volatility_expr("raw_return", MONTHS).alias("annualized_volatility"),
        sharpe_expr("raw_return", 0.0, MONTHS).alias("sharpe_ratio"),
        F.min("price_drawdown").alias("max_drawdown"),
        (last_value("relative") / 100.0 - 1.0).alias("excess_total_return"),
        F.min("drawdown").alias("excess_max_drawdown"),
        F.count(F.lit(1)).alias("months"),
    )


def relative_return(returns: DataFrame, target: str, control: str, value: str = "ret") -> DataFrame:
    """Target minus control on the dates where both are present."""
    both = returns.where(F.col("market").isin(target, control)).groupBy("date").agg(
        F.max(F.when(F.col("market") == target, col(value))).alias("_t"),
        F.max(F.when(F.col("market") == control, col(value))).alias("_c"),
    )
    return both.where(F.col("_t").isNotNull() & F.col("_c").isNotNull()).select(
        "date", F.lit(f"{target}_VS_{control}").alias("market"),
        (F.col("_t") - F.col("_c")).alias(value),
    )


# --- windows of named events -----------------------------------------------------

def event_window_change(prices: DataFrame, events: DataFrame) -> DataFrame:
    """Percent move from first to last complete date inside each named window.

    Windows are expanded to days, which makes the range join an equi-join on
    the date; complete means every market has a price.  Windows with fewer than
    two such dates, and windows that end before they start, give no row.
    """
    ordered = events.where("start_date <= end_date")
    days = ordered.select("event_id", F.explode(F.sequence("start_date", "end_date")).alias("date"))
    inside = drop_any(prices).join(days, "date")
    return (
        inside.groupBy("event_id", "market")
        .agg(
            (change(last_value(), first_value()) * 100.0).alias("pct_change"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n >= 2")
    )


def cross_decomposition(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Percent change of both sides of each pair over their common dates.

    ``pairs(market_a, market_b)`` lists the requested pairs; each price row is
    joined once per pair that names it, then aligned on (pair, date).
    """
    listed = pairs.select(
        "market_a", "market_b", F.posexplode(F.array("market_a", "market_b")).alias("side", "market")
    )
    present = prices.where(F.col("price").isNotNull())
    aligned = (
        present.join(listed, "market")
        .groupBy("market_a", "market_b", "date")
        .agg(
            F.max(F.when(F.col("side") == 0, F.col("price"))).alias("a"),
            F.max(F.when(F.col("side") == 1, F.col("price"))).alias("b"),
        )
        .where(F.col("a").isNotNull() & F.col("b").isNotNull())
    )
    return (
        aligned.groupBy("market_a", "market_b")
        .agg(
            F.min("date").alias("start_date"),
            F.max("date").alias("end_date"),
            (change(last_value("a"), first_value("a")) * 100.0).alias("a_pct_change"),
            (change(last_value("b"), first_value("b")) * 100.0).alias("b_pct_change"),
            F.count(F.lit(1)).alias("n"),
        )
        .where("n >= 2")
        .drop("n")
    )
