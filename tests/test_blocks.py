"""Lags in blocks with a halo against one window."""

import re

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import blocks
from tidemark.operators import regression as rg


@pytest.fixture(scope="module")
def series(spark):
    """One hot series of 300 rows, a short one, a single row and a null key; days in no order."""
    rng = np.random.default_rng(4)
    rows = [(k, int(i), float(rng.normal()) if i % 11 else None) for k, n in (("hot", 300), ("short", 5), ("one", 1), (None, 9)) for i in rng.permutation(n)]
    return spark.createDataFrame(rows, "k string, day int, v double").repartition(7)


@pytest.mark.parametrize("size", [1, 3, 7, 100, 1000])
def test_blocks_equal_one_window(series, size):
    lags = {"a": ("v", 1), "b": ("day", 3), "same": ("v", 0), "far": ("v", 7)}
    w = W.partitionBy("k").orderBy("day")
    want = series.withColumns({o: F.lag(c, n).over(w) if n else F.col(c) for o, (c, n) in lags.items()}).withColumn("_place", F.row_number().over(w).cast("long"))
    got = blocks.with_lags(series, ["k"], "day", lags, size).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_without_keys_empty_and_zero_lags(series):
    lags = {"a": ("v", 2)}
    hot = series.where("k = 'hot'")
    got = {r.day: r.a for r in blocks.with_lags(hot, [], "day", lags, 4).collect()}
    values = {r.day: r.v for r in hot.collect()}
    assert got == {day: values.get(day - 2) for day in values}
    assert blocks.with_lags(hot.limit(0), [], "day", lags).count() == 0
    assert blocks.with_lags(hot, [], "day", {"b": ("v", 0)}).where("not (b <=> v)").count() == 0


def test_a_fit_without_groups_sorts_no_series_in_one_task(spark, monkeypatch):
    """Blocks and windows give the same tests, and lags run over blocks only."""
    monkeypatch.setattr(blocks.with_lags, "__defaults__", (8,))
    rng = np.random.default_rng(12)
    x = rng.normal(size=90).cumsum()
    u = np.zeros(90)
    for i in range(1, 90):
        u[i] = 0.6 * u[i - 1] + rng.normal()
    df = spark.createDataFrame([(i, float(a), float(1 + 2 * a + b)) for i, (a, b) in enumerate(zip(x, u))], "date int, x double, y double").repartition(6)
    window, block = (rg.ols(df, "y", ("intercept", "x"), blocked=b).settle() for b in (False, None))

    def close(test, fits):
        a, b = (test(f).orderBy(test(f).columns[0]).collect() for f in fits)
        assert len(a) == len(b)
        for left, right in zip(a, b):
            assert [v if isinstance(v, (str, bool, int)) else pytest.approx(v, rel=1e-9) for v in left] == list(right)

    close(lambda f: rg.hac(f, 5), (window, block))
    close(lambda f: rg.breusch_godfrey(f, 4), (window, block))
    close(lambda f: rg.adf(f.rows, blocked=f.blocked), (window, block))
    a, b = (sorted(r.date for r in rg.drop_ends(df, 12, blocked=k).where("variant = 'without_last'").collect()) for k in (False, None))
    assert a == b == list(range(78))
    plan = block.lagged(block.rows, {"l": ("resid", 5)})._jdf.queryExecution().executedPlan().toString()
    lagging = [line for line in plan.splitlines() if "lag(" in line and "Window" in line]
    assert lagging and all("_block" in line for line in lagging)
    assert not re.search(r"SinglePartition", plan)
