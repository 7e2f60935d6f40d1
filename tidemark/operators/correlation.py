"""Pairwise, ranked and rolling correlation of return series.

Two formulations are used.  With *named pairs* (the usual case: a few markets
against a few others) the pair list drives equi-joins on (market, date), so
only the requested pairs are ever formed.  For *every* pair of a whole market
set, moments come from blocked matrix products over date chunks: a task holds
two market blocks of one chunk and emits one partial row per pair, never one
row per pair and date.
(J16, A20-A24, A27-A30, W10, W15, W16, T2, T3)
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions.moments import correlation, pair_count
from tidemark.functions.scalars import col, ratio
from tidemark.operators.growth import pct_change, trailing
from tidemark.operators.ranks import ranked_values
from tidemark.session import settle

PAIR = ("market_a", "market_b")
PAIR_SCHEMA = "market_a string, market_b string"


def market_pairs(spark: SparkSession, rows: Iterable[str], columns: Iterable[str]) -> DataFrame:
    """The requested cells of a matrix of two named market lists."""
    cells = [(a, b) for a in rows for b in columns]
    return spark.createDataFrame(cells, PAIR_SCHEMA)


def unordered_pairs(spark: SparkSession, markets: Iterable[str]) -> DataFrame:
    """Each pair of a named market list once, in list order."""
    names = list(dict.fromkeys(markets))
    cells = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return spark.createDataFrame(cells, PAIR_SCHEMA)


def aligned_pairs(returns: DataFrame, pairs: DataFrame, value: str = "ret") -> DataFrame:
    """Rows (market_a, market_b, date, x, y) where both markets have a value."""
    # The same filter on both sides lets the join reuse one exchange below it.
    usable = col(value).isNotNull() & F.col("date").isNotNull() & F.col("market").isNotNull()
    present = returns.where(usable).select("date", "market", col(value))
    left = present.select("date", F.col("market").alias("market_a"), col(value).alias("x"))
    right = present.select("date", F.col("market").alias("market_b"), col(value).alias("y"))
    return left.join(pairs, "market_a").join(right, ["market_b", "date"]).select(
        *PAIR, "date", "x", "y"
    )


def every_pair(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each requested pair: null and n = 0 where it has no common date."""
    return pairs.select(*PAIR).distinct().join(found, list(PAIR), "left").withColumn(
        "n", F.coalesce(F.col("n"), F.lit(0).cast("long")))


def pearson_matrix(returns: DataFrame, pairs: DataFrame, value: str = "ret") -> DataFrame:
    """Pairwise-complete Pearson correlation; null for a constant side or no common date."""
    found = aligned_pairs(returns, pairs, value).groupBy(*PAIR).agg(
        correlation("x", "y").alias("corr"), pair_count("x", "y").alias("n"))
    return every_pair(pairs, found)


def avg_rank(value, keys) -> Column:
    """Rank with ties averaged, within ``keys``."""
    v = col(value)
    ties = F.count(F.lit(1)).over(W.partitionBy(*[col(k) for k in keys], v))
    low = F.rank().over(W.partitionBy(*[col(k) for k in keys]).orderBy(v))
    return low + (ties - 1) / F.lit(2.0)


def avg_rank_by_value(df: DataFrame, value: str, keys) -> DataFrame:
    """Average rank of each distinct value within its keys; a hot key is split by its values."""
    return ranked_values(df, list(keys), value).select(*keys, value, "avg_rank")


def spearman_matrix(returns: DataFrame, pairs: DataFrame, value: str = "ret") -> DataFrame:
    """Pearson correlation of average ranks over each pair's complete rows."""
    rows = settle(aligned_pairs(returns, pairs, value))
    sides = rows.select(*PAIR, F.explode(F.array(*[
        F.struct(F.lit(side).alias("side"), F.col(side).alias("value")) for side in ("x", "y")])).alias("v"))
    ranks = settle(ranked_values(sides.select(*PAIR, "v.side", "v.value"), [*PAIR, "side"], "value"))

    def of(side: str) -> DataFrame:
        return ranks.where(F.col("side") == side).select(*PAIR, F.col("value").alias(side), F.col("avg_rank").alias(f"r{side}"))

    ranked = rows.join(of("x"), [*PAIR, "x"]).join(of("y"), [*PAIR, "y"]).select(
        *PAIR, F.col("rx").alias("x"), F.col("ry").alias("y"))
    return every_pair(pairs, ranked.groupBy(*PAIR).agg(
        correlation("x", "y").alias("corr"), pair_count("x", "y").alias("n")
    ))


def kendall_matrix(returns: DataFrame, pairs: DataFrame, value: str = "ret") -> DataFrame:
    """Kendall tau-b over each pair's complete rows."""
    return kendall_of(aligned_pairs(returns, pairs, value))


def kendall_of(aligned: DataFrame) -> DataFrame:
    """Kendall tau-b of aligned (pair, date, x, y) rows.

    Discordant pairs are the inversions of y in x order.  They are counted one
    binary digit of y's dense rank at a time: among rows that agree on all
    higher digits, a row with digit 0 is inverted with every earlier row with
    digit 1.  That is n log n rows of running counts instead of n squared pairs
    of observations, which are never formed.
    """
    by_pair = W.partitionBy(*PAIR)
    rows = settle(aligned.select(
        *PAIR, "date", "x", "y",
        (F.dense_rank().over(by_pair.orderBy("y")) - 1).alias("y_rank"),
    ))
    width = F.ceil(F.log2(F.max("y_rank").over(by_pair) + 1.0)).cast("int")
    digits = rows.withColumn("_width", F.greatest(width, F.lit(1))).select(
        *PAIR, "x", "y", "y_rank",
        F.explode(F.sequence(F.lit(0), F.col("_width") - 1)).alias("digit"),
    ).withColumns({
        "prefix": F.expr("shiftright(y_rank, digit + 1)"),
        "bit": F.expr("shiftright(y_rank, digit) & 1"),
    })
    # Ties in x come in y order, so they never count as inverted.
    earlier = (
        W.partitionBy(*PAIR, "digit", "prefix")
        .orderBy("x", "y")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    inverted = digits.withColumn(
        "_inv", F.when(F.col("bit") == 0, F.coalesce(F.sum("bit").over(earlier), F.lit(0))).otherwise(0)
    )
    discordant = inverted.groupBy(*PAIR).agg(F.sum("_inv").alias("discordant"))

    def tied(*names: str) -> DataFrame:
        """Pairs of observations equal on the named columns."""
        label = "ties_" + "".join(names)
        sizes = rows.groupBy(*PAIR, *names).agg(F.count(F.lit(1)).alias("_c"))
        return sizes.groupBy(*PAIR).agg(F.sum(F.expr("_c * (_c - 1) / 2")).alias(label))

    sizes = rows.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    joined = sizes
    for part in (tied("x"), tied("y"), tied("x", "y"), discordant):
        joined = joined.join(part, list(PAIR))
    total = F.expr("n * (n - 1) / 2")
    surplus = (
        total - F.col("ties_x") - F.col("ties_y") + F.col("ties_xy") - 2 * F.col("discordant")
    )
    scale = F.sqrt(total - F.col("ties_x")) * F.sqrt(total - F.col("ties_y"))
    return joined.select(*PAIR, ratio(surplus, scale).alias("corr"), "n")


# --- every pair of a market set ------------------------------------------------

MOMENTS = T.StructType([
    T.StructField("market_a", T.StringType()),
    T.StructField("market_b", T.StringType()),
    *[T.StructField(m, T.DoubleType()) for m in ("n", "sx", "sy", "sxx", "syy", "sxy")],
])


def _block_moments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Partial pair moments of two market blocks over one chunk of dates."""
    a, b = pdf["block_a"].iloc[0], pdf["block_b"].iloc[0]
    wide = pdf.pivot(index="date", columns="market", values="v")
    home = pdf.drop_duplicates("market").set_index("market")["block"]
    left = [m for m in wide.columns if home[m] == a]
    right = [m for m in wide.columns if home[m] == b]
    x, y = wide[left].to_numpy(float), wide[right].to_numpy(float)
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    tables = (mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y)
    out = pd.DataFrame({
        "market_a": np.repeat(left, len(right)),
        "market_b": np.tile(right, len(left)),
        **{name: t.reshape(-1) for name, t in zip(MOMENTS.names[2:], tables)},
    })
    ordered = out["market_a"] < out["market_b"]
    if a != b:
        swapped = out[~ordered].rename(columns={
            "market_a": "market_b", "market_b": "market_a",
            "sx": "sy", "sy": "sx", "sxx": "syy", "syy": "sxx",
        })
        out = pd.concat([out[ordered], swapped[MOMENTS.names]])
    else:
        out = out[ordered]
    return out[out["n"] > 0][MOMENTS.names]


BLOCK_MARKETS = 64


def pairwise_correlations(returns: DataFrame, value: str = "ret") -> DataFrame:
    """Correlation of every unordered market pair, pairwise complete.

    Blocks of about ``BLOCK_MARKETS`` markets, as many as the market count
    asks for, and calendar years form the groups, so a group holds two blocks
    of one year whatever the number of markets.  Values are centred per market
    first, which keeps the raw moments well conditioned.
    """
    present = returns.where(col(value).isNotNull()).select("date", "market", col(value).alias("v"))
    markets = present.select(F.count_distinct("market")).scalar()
    blocks = F.greatest(F.lit(1), F.ceil(markets / float(BLOCK_MARKETS))).cast("int")
    means = present.groupBy("market").agg(F.avg("v").alias("_mean"), F.stddev_samp("v").alias("_sd"))
    centred = present.join(means, "market").select(
        "date", "market",
        F.coalesce(ratio(F.col("v") - F.col("_mean"), "_sd"), F.lit(0.0)).alias("v"),
        F.pmod(F.xxhash64("market"), blocks).cast("int").alias("block"),
        F.year("date").alias("chunk"),
    )
    spread = centred.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "date", "market", "v", "block", "chunk",
        F.least("block", "other").alias("block_a"),
        F.greatest("block", "other").alias("block_b"),
    )
    partial = spread.groupBy("block_a", "block_b", "chunk").applyInPandas(_block_moments, MOMENTS)
    total = partial.groupBy(*PAIR).agg(*[F.sum(m).alias(m) for m in MOMENTS.names[2:]])
    n = F.col("n")
    cov = F.col("sxy") - ratio(F.col("sx") * F.col("sy"), n)
    vx = F.col("sxx") - ratio(F.col("sx") * F.col("sx"), n)
    vy = F.col("syy") - ratio(F.col("sy") * F.col("sy"), n)
    # A side that is constant over the common dates leaves only rounding dust.
    live = (vx > n * 1e-24) & (vy > n * 1e-24)
    return total.select(
        *PAIR, F.when(live, ratio(cov, F.sqrt(vx) * F.sqrt(vy))).alias("corr"), n.cast("long").alias("n")
    )


# --- currency against equity, rolling -----------------------------------------

def returns_on_common_dates(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: align prices first, then difference both sides."""
    aligned = aligned_pairs(prices, pairs, "price")
    staged = pct_change(aligned, "x", PAIR, "date", "rx")
    staged = pct_change(staged, "y", PAIR, "date", "ry")
    return staged.where(F.col("rx").isNotNull() & F.col("ry").isNotNull()).select(
        *PAIR, "date", F.col("rx").alias("x"), F.col("ry").alias("y")
    )


def fx_equity_correlation(prices: DataFrame, pairs: DataFrame) -> DataFrame:
    return returns_on_common_dates(prices, pairs).groupBy(*PAIR).agg(
        correlation("x", "y").alias("corr"), pair_count("x", "y").alias("n")
    )


def rolling_correlation(aligned: DataFrame, n: int = 90, keys=PAIR) -> DataFrame:
    """Correlation of the last ``n`` aligned rows; incomplete frames dropped."""
    w = trailing(keys, "date", n)
    full = F.count(F.lit(1)).over(w) == n
    return (
        aligned.withColumn("corr", F.when(full, correlation("x", "y", over=w)))
        .where("corr is not null")
        .select(*[col(k) for k in keys], "date", "corr")
    )


def correlation_stability(rolling: DataFrame, keys=PAIR) -> DataFrame:
    """Mean, deviation, minimum and maximum per pair; single-row pairs drop."""
    return (
        rolling.groupBy(*keys)
        .agg(
            F.avg("corr").alias("mean_corr"),
            F.stddev_samp("corr").alias("std_corr"),
            F.min("corr").alias("min_corr"),
            F.max("corr").alias("max_corr"),
        )
        .where("std_corr is not null")
    )


def rolling_correlation_volatility(rolling: DataFrame, keys=PAIR) -> DataFrame:
    return (
        rolling.groupBy(*keys)
        .agg(F.stddev_samp("corr").alias("corr_volatility"))
        .where("corr_volatility is not null")
    )


def latest_rolling(rolling: DataFrame, keys=PAIR) -> DataFrame:
    return rolling.groupBy(*keys).agg(
        F.max_by("corr", "date").alias("latest_corr"), F.max("date").alias("date")
    )


# --- summaries of a matrix in long form ---------------------------------------

def average_correlations(matrix: DataFrame, side: str = "market_a") -> DataFrame:
    """Mean over a row (market_a) or a column (market_b); nulls skipped."""
    return matrix.groupBy(side).agg(F.avg("corr").alias("avg_corr")).where("avg_corr is not null")


def correlation_spread(matrix: DataFrame, side: str = "market_a") -> DataFrame:
    return matrix.groupBy(side).agg((F.max("corr") - F.min("corr")).alias("spread"))


def ranked_counterparts(matrix: DataFrame, by: str = "market_a") -> DataFrame:
    """Counterparts of each market from the highest correlation down."""
    other = "market_b" if by == "market_a" else "market_a"
    w = W.partitionBy(by).orderBy(F.col("corr").desc_nulls_last(), other)
    return matrix.withColumn("rank", F.row_number().over(w))


def _extreme(matrix: DataFrame, strongest: bool) -> DataFrame:
    order = F.col("corr").desc() if strongest else F.col("corr").asc()
    w = W.partitionBy("market_a").orderBy(order, "market_b")
    picked = matrix.where("corr is not null").withColumn("_rank", F.row_number().over(w))
    return picked.where("_rank = 1").select(*PAIR, "corr")


def strongest(matrix: DataFrame) -> DataFrame:
    """Highest counterpart per market, first by name on ties."""
    return _extreme(matrix, True)


def weakest(matrix: DataFrame) -> DataFrame:
    return _extreme(matrix, False)
