"""Expected values of prices, returns and windows on small literal frames."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import correlation as co
from tidemark.operators import filters as fl
from tidemark.operators import growth as gr
from tidemark.operators import lagged as lg
from tidemark.operators import market as mk
from tidemark.plans import products as pr

MARKETS = ["CAPITAL_GOODS", "INFRASTRUCTURE", "MANUFACTURING", "NIFTY_50", "FMCG"]
GROWTH = [1.018, 1.014, 1.012, 1.008, 1.006]
MONTHS = pd.date_range("2018-04-30", periods=84, freq="ME")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    """A few markets make several blocks."""
    monkeypatch.setattr(co, "BLOCK_MARKETS", 2)



@pytest.fixture(scope="module")
def prices(spark):
    rows = [(d.date(), m, 100 * g**i) for i, d in enumerate(MONTHS) for m, g in zip(MARKETS, GROWTH)]
    return spark.createDataFrame(rows, "date date, market string, price double")


def test_performance_of_exponential_markets(prices):
    rows = mk.sector_performance(prices, "NIFTY_50", MARKETS).toPandas()
    bench = rows[rows.market == "NIFTY_50"].sort_values("date")
    assert len(bench) == 84 and (bench.relative == 100).all() and (bench.excess == 0).all()
    assert bench.rolling_12m_excess.notna().sum() == 73
    first = rows[rows.date == rows.date.min()].set_index("market")
    assert (first.normalized_value == 100).all() and first.raw_return.isna().all()
    goods = rows[rows.market == "CAPITAL_GOODS"].sort_values("date")
    # The first excess return is missing, so the window fills one month later.
    assert goods.rolling_12m_excess.notna().sum() == 72
    assert goods.rolling_12m_excess.iloc[-1] == pytest.approx(12 * 0.010)
    assert goods.relative.iloc[-1] == pytest.approx(100 * (1.018 / 1.008) ** 83)
    assert (rows.drawdown.dropna() <= 0).all()


def test_summary(prices):
    table = mk.market_summary(mk.sector_performance(prices, "NIFTY_50", MARKETS)).toPandas().set_index("market")
    assert table.total_return["FMCG"] == pytest.approx(1.006**83 - 1)
    assert table.cagr["FMCG"] == pytest.approx(1.006**12 - 1)
    assert table.excess_total_return["NIFTY_50"] == 0 and table.max_drawdown["NIFTY_50"] == 0


def test_forty_three_lag_series(spark, prices):
    values = [100, 110, 125, 150, 190, 240, 300]
    actual = spark.createDataFrame([(dt.date(2018 + i, 3, 31), float(v)) for i, v in enumerate(values)], "date date, value double")
    private = spark.createDataFrame(
        [("private_gfcf", dt.date(2018 + i, 3, 31), 10.0 + i) for i in range(7)], "outcome_key string, date date, outcome double")
    performance, _ = pr.market_performance(prices, "NIFTY_50", MARKETS)
    table = pr.lag_analysis(pr.growth_of(actual), performance, MARKETS[:3], "NIFTY_50", "FMCG", private)
    rows = table.toPandas()
    # 7 market series by 6 windows and 3 year lags; the driver itself is the 43rd.
    market = rows[rows.outcome_type == "market"]
    assert market.series.nunique() == 7 and len(market) == 42
    assert set(rows[rows.outcome_type == "real_economy"].lag) == {0, 1, 2}
    assert rows[(rows.series == "NIFTY_50") & (rows.direction == "capex_leads") & (rows.lag == 0)].n.iloc[0] == 6


def test_common_period_names_missing_market(prices):
    with pytest.raises(fl.InputError, match="GOLD"):
        fl.common_period(prices, [*MARKETS, "GOLD"], check=True)


def test_positional_calendar_and_nonnull_lags_differ(spark):
    rows = [(dt.date(2020, 3, 31), 100.0), (dt.date(2021, 3, 31), None), (dt.date(2022, 3, 31), 120.0), (dt.date(2024, 3, 31), 150.0)]
    df = spark.createDataFrame(rows, "date date, value double").withColumn("k", F.lit("a"))
    positional = [r.ret for r in gr.pct_change(df, "value", ("k",)).orderBy("date").collect()]
    assert positional[:3] == [None, None, None] and positional[3] == pytest.approx(0.25)
    nonnull = [r.growth for r in gr.growth_prev_nonnull(df, keys=("k",)).orderBy("date").collect()]
    assert nonnull[:2] == [None, None] and nonnull[2:] == [pytest.approx(20.0), pytest.approx(25.0)]
    calendar = [r["diff"] for r in gr.period_diff(df, "annual", keys=("k",)).orderBy("date").collect()]
    assert calendar == [None, None, None, None]


def test_risk_edge_cases(spark):
    rows = [(dt.date(2024, 1, d), m, p) for m, ps in {
        "flat": [10.0, 10.0, 10.0], "up": [10.0, 11.0, 12.5], "onedown": [10.0, 9.0, 9.5]}.items() for d, p in enumerate(ps, 1)]
    df = spark.createDataFrame(rows, "date date, market string, price double")
    rets = mk.with_returns(df)
    down = {r.market: r.downside_volatility for r in mk.downside_volatility(rets).collect()}
    assert down == {"flat": 0.0, "up": 0.0, "onedown": None}
    assert {r.market: r.sharpe for r in mk.sharpe(rets).collect()}["flat"] is None
    assert {r.market: r.calmar for r in mk.calmar(df).collect()}["up"] == 0.0


def test_correlations_match_pandas(spark):
    rng = np.random.default_rng(3)
    wide = pd.DataFrame(np.round(rng.normal(size=(120, 6)), 1), columns=list("abcdef"), index=pd.date_range("2023-01-01", periods=120))
    wide["f"] = 1.0
    wide.iloc[5:30, 1] = np.nan
    wide.iloc[20:60, 3] = np.nan
    long = wide.stack().rename("ret").rename_axis(["date", "market"]).reset_index()
    df = spark.createDataFrame(long.assign(date=long.date.dt.date), "date date, market string, ret double")
    pairs = co.unordered_pairs(spark, "abcdef")
    ranked = {m: wide.corr(method="spearman") if m == "spearman" else wide.corr(method="pearson") for m in ("pearson", "spearman")}

    def tau(x, y):
        x, y = x.to_numpy(), y.to_numpy()
        dx, dy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        scale = math.sqrt((dx != 0).sum() * (dy != 0).sum())
        return (dx * dy).sum() / scale if scale else float("nan")

    for fn, expected in (
        (co.pearson_matrix, lambda a, b: ranked["pearson"].loc[a, b]),
        (co.kendall_matrix, lambda a, b: tau(*[c for _, c in wide[[a, b]].dropna().items()])),
        (lambda r_, p_: co.pairwise_correlations(r_), lambda a, b: ranked["pearson"].loc[a, b]),
        (co.spearman_matrix, lambda a, b: wide[[a, b]].dropna().rank().corr().iloc[0, 1]),
    ):
        got = {(r.market_a, r.market_b): r["corr"] for r in fn(df, pairs).collect()}
        assert len(got) == 15
        for (a, b), value in got.items():
            want = expected(a, b)
            if math.isnan(want):
                assert value is None
            else:
                assert value == pytest.approx(want, abs=1e-12)


def test_hot_market_does_not_change_pairs(spark):
    """Many more rows of one market still give one value per pair."""
    days = pd.date_range("2000-01-01", periods=900).date
    rows = [(d, "hot", math.sin(i)) for i, d in enumerate(days)] + [(d, m, math.cos(i + j)) for j, m in enumerate("xyz") for i, d in enumerate(days[:40])]
    df = spark.createDataFrame(rows, "date date, market string, ret double")
    got = {(r.market_a, r.market_b): r.n for r in co.pairwise_correlations(df).collect()}
    assert len(got) == 6 and set(got.values()) == {40}


def test_window_joins_are_half_open(spark):
    anchors = spark.createDataFrame([(dt.date(2020, 3, 31), 1.0)], "date date, driver double")
    months = pd.date_range("2019-01-31", periods=40, freq="ME")
    df = spark.createDataFrame([(d.date(), "m", 0.01 * (i + 1)) for i, d in enumerate(months)], "date date, market string, ret double")
    r = {d.date(): 0.01 * (i + 1) for i, d in enumerate(months)}

    def compound(start, end):
        return (math.prod(1 + v for d, v in r.items() if start < d <= end) - 1) * 100

    got = {x.offset: x for x in lg.forward_window_return(anchors, df, (0, 6)).collect()}
    assert got[0].window_return == pytest.approx(compound(dt.date(2020, 3, 31), dt.date(2021, 3, 31)))
    assert got[6].window_return == pytest.approx(compound(dt.date(2020, 9, 30), dt.date(2021, 9, 30)))
    back = {x.offset: x for x in lg.backward_window_return(anchors, df, (3, 6)).collect()}
    assert back[3].window_return == pytest.approx(compound(dt.date(2018, 12, 31), dt.date(2019, 12, 31)))
    assert back[6].n == 9 and 12 not in back
