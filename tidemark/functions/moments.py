"""Correlation and variance expressions that are null on degenerate input.

The built-in ``corr`` raises under ANSI mode when one side is constant, so it
is rebuilt from covariance and deviations over the rows where both are set.
Each helper yields an aggregate; pass ``over`` to use it as a window aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import col, ratio


def _over(c: Column, window) -> Column:
    return c if window is None else c.over(window)


def both(x, y, where: Column | None = None) -> tuple[Column, Column]:
    a, b = col(x).cast("double"), col(y).cast("double")
    keep = a.isNotNull() & b.isNotNull()
    if where is not None:
        keep = keep & where
    return F.when(keep, a), F.when(keep, b)


def pair_count(x, y, where: Column | None = None, over=None) -> Column:
    a, b = both(x, y, where)
    return _over(F.count(a), over)


def correlation(x, y, where: Column | None = None, over=None) -> Column:
    a, b = both(x, y, where)
    return ratio(
        _over(F.covar_samp(a, b), over),
        _over(F.stddev_samp(a), over) * _over(F.stddev_samp(b), over),
    )


def full_window(value, n: int, window, stat: Column) -> Column:
    """A rolling statistic that stays null until ``n`` values are in the frame."""
    return F.when(F.count(col(value)).over(window) >= n, stat)
