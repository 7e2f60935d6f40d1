"""Running totals and ranks whose keys may be larger than a task.

Rows are dealt by ranges of (keys, order), so a key that holds most rows is
split by its values.  Each range is totalled, the totals are carried across the
ranges of a key, and only then are rows numbered inside their range.  What is
carried has one row per key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import settle

_PART, _BEFORE, _TIE = "_rank_part", "_rank_before", "_rank_tie"


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: Column | str,
                  out: str, exclusive: bool = False) -> DataFrame:
    """Sum of ``weight`` within ``keys`` over all rows up to each row in ``order``.

    Rows that tie in ``order`` are totalled in an order that is arbitrary but
    fixed for the result; ``exclusive`` leaves the row itself out.  Null keys
    are a key.
    """
    keys = list(keys)
    names = [f"_rank_order_{k}" for k in range(len(order))]
    staged = df.withColumns({
        # Ties may hold most rows, so they are dealt by where they come from.
        _TIE: F.monotonically_increasing_id(),
        "_rank_weight": F.col(weight) if isinstance(weight, str) else weight,
    })
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    ranged = staged.repartitionByRange(*[F.col(k) for k in keys], *columns, _TIE)
    rows = settle(ranged.withColumn(_PART, F.spark_partition_id()))
    totals = rows.groupBy(*keys, _PART).agg(F.sum("_rank_weight").alias("_rank_total"))
    earlier = W.partitionBy(*keys).orderBy(_PART).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_rank_key_{i}") for i, k in enumerate(keys)], F.col(_PART).alias("_rank_part_of"),
        F.coalesce(F.sum("_rank_total").over(earlier), F.lit(0)).alias(_BEFORE),
    )
    same = F.col(_PART) == F.col("_rank_part_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_rank_key_{i}"))
    last = -1 if exclusive else 0
    inside = W.partitionBy(*keys, _PART).orderBy(*columns, _TIE).rowsBetween(W.unboundedPreceding, last)
    held = rows.withColumn("_rank_inside", F.coalesce(F.sum("_rank_weight").over(inside), F.lit(0)))
    return held.join(carried, same).withColumn(out, F.col(_BEFORE) + F.col("_rank_inside")).select(*df.columns, out)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str = "place") -> DataFrame:
    """Row numbers 1, 2, ... within ``keys``, as ``row_number`` gives them."""
    return running_total(df, keys, order, F.lit(1).cast("long"), out)


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``keys, value, n, min_rank, avg_rank`` of each distinct non-null value.

    Rows are counted by value before anything is dealt, so neither a value nor
    a key that most rows share is gathered.
    """
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    below = running_total(counts, keys, [value], "n", "_below", exclusive=True)
    return below.select(
        *keys, value, "n", (F.col("_below") + 1).alias("min_rank"),
        (F.col("_below") + (F.col("n") + 1) / F.lit(2.0)).alias("avg_rank"),
    )
