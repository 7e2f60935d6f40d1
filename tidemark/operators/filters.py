"""Row selection with the pipeline's gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scalars import col
from tidemark.schema import SETTLED_EXCLUDES


class InputError(ValueError):
    """Input that an operator must refuse."""


def select_records(df: DataFrame, keys, start=None, key: str = "indicator") -> DataFrame:
    """Indicator set and date floor; both reach the scan."""
    kept = df.where(col(key).isin(list(keys)))
    return kept if start is None else kept.where(F.col("date") >= F.lit(start).cast("date"))


def slice_dates(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    return df.where(col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_any(df: DataFrame, n_markets=None, market: str = "market", value: str = "price") -> DataFrame:
    """Keep the dates on which every market of a long frame has a value.

    ``n_markets`` is the expected market count; without it the distinct markets
    are counted in a scalar subquery.  Complete dates are counted with partial
    sums and met in a semi join, so no row carries the markets of its date.
    """
    present = df.where(col(value).isNotNull())
    if n_markets is None:
        n_markets = df.select(F.count_distinct(col(market))).scalar()
    seen = present.groupBy("date").agg(F.count_distinct(col(market)).alias("_n")).where(F.col("_n") == n_markets)
    return present.join(seen.select("date"), "date", "left_semi")


def drop_all(df: DataFrame, columns) -> DataFrame:
    """Drop rows of a wide frame in which every listed column is null."""
    return df.dropna("all", subset=list(columns))


def common_period(prices: DataFrame, required, *, check: bool = False) -> DataFrame:
    """Rows of the required markets on dates where all of them have a price.

    ``check=True`` runs a bounded action that refuses a required market without
    any price.
    """
    required = list(required)
    kept = prices.where(F.col("market").isin(required) & F.col("price").isNotNull())
    if check:
        found = {r[0] for r in kept.select("market").distinct().limit(len(required)).collect()}
        missing = [m for m in required if m not in found]
        if missing:
            raise InputError(f"Missing required market histories: {', '.join(missing)}")
    return drop_any(kept, len(required))


def settled(df: DataFrame) -> DataFrame:
    """Observations that are neither budget nor estimate."""
    return df.where(~F.col("status").isin(*SETTLED_EXCLUDES))


def gate_min_n(df: DataFrame, keys, n: int, value: str = "value") -> DataFrame:
    """Rows of the keys that have at least ``n`` non-null values."""
    keys = list(keys)
    enough = df.groupBy(*keys).agg(F.count(col(value)).alias("_n")).where(F.col("_n") >= n)
    return df.join(enough.select(*keys), keys, "left_semi")


def exclude_years(df: DataFrame, years, year: str = "year") -> DataFrame:
    return df.where(~col(year).isin(list(years)))


def exclude_range(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    return df.where(~col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def all_status(df: DataFrame, columns, status: str = "actual") -> DataFrame:
    """Rows on which every listed status column has the given status."""
    condition: Column = F.lit(True)
    for name in columns:
        condition = condition & (col(name) == status)
    return df.where(condition)


def drop_most_influential(df: DataFrame, by=(), influence: str = "cooks", order: str = "date") -> DataFrame:
    """Drop one row per fit: the largest influence, earliest on ties."""
    w = W.partitionBy(*by).orderBy(col(influence).desc_nulls_last(), col(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank > 1").drop("_rank")


def downside(df: DataFrame, value: str = "ret") -> DataFrame:
    return df.where(col(value) < 0)
