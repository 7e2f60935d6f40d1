"""Lags along one series that may be longer than a task's share.

Rows are numbered by ranges of their order (``ranks``), cut into blocks of
consecutive places, and each block receives a halo: copies of the rows before
it that its first rows look back to.  A window then runs inside a block, so no
task sorts more than a block and its halo.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.ranks import numbered

#: Rows of a block; a block is never shorter than the longest lag.
BLOCK_ROWS = 100_000
PLACE = "_place"


def placed(df: DataFrame, keys, order: str) -> DataFrame:
    """Rows with their place 1, 2, ... in the order of their series."""
    return df if PLACE in df.columns else numbered(df, keys, [order], PLACE)


def with_lags(df: DataFrame, keys, order: str, lags: Mapping[str, tuple[str, int]],
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``out: (column, lag)`` columns as ``lag`` over the whole series gives them.

    The value of the row ``lag`` places earlier, null before the start of the
    series.  ``_place`` stays among the columns.  Rows that tie in ``order``
    have an arbitrary but fixed place.
    """
    keys = list(keys)
    rows = placed(df, keys, order)
    longest = max((lag for _, lag in lags.values()), default=0)
    if longest == 0:
        return rows.withColumns({out: F.col(c) for out, (c, _) in lags.items()})
    size = max(block_rows, longest)
    index = F.col(PLACE) - 1
    own = F.floor(index / size).cast("long")
    # The last rows of a block are also the halo of the next one.
    also = F.when(F.pmod(index, F.lit(size)) >= size - longest, own + 1)
    entries = F.array_compact(F.array(own, also))
    held = rows.withColumn("_own", own).withColumn("_block", F.explode(entries))
    inside = W.partitionBy(*keys, "_block").orderBy(PLACE)
    lagged = held.withColumns({out: F.lag(c, lag).over(inside) if lag else F.col(c) for out, (c, lag) in lags.items()})
    return lagged.where("_own = _block").drop("_own", "_block")
