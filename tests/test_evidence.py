"""Alignment rules, regression against numpy, tails, gates and grades."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import numerics as nx
from tidemark.operators import alignment as al
from tidemark.operators import evidence as ev
from tidemark.operators import regression as rg
from tidemark.plans import evidence_report as er


def annual(spark, values, status=None, start=2020):
    rows = [(dt.date(start + i, 3, 31), float(v), (status or {}).get(i, "actual")) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, value double, status string")


def debt_inputs(spark, status=None):
    return {
        "interest_burden_change": annual(spark, [10, 12, 15, 19], status),
        "lagged_general_government_debt": annual(spark, [70, 72, 74, 76]),
        "lagged_primary_balance": annual(spark, [-3, -2, -1, 0]),
    }


def test_differences_and_lags(spark):
    sample = al.align(debt_inputs(spark), er.DEBT_INTEREST.inputs, "lag_then_inner_join").sample.orderBy("date").collect()
    assert [r.date.year for r in sample] == [2021, 2022, 2023]
    assert tuple(sample[0][n] for n in ("interest_burden_change", "lagged_general_government_debt", "lagged_primary_balance")) == (2, 70, -3)
    assert sample[0].lagged_general_government_debt__source_date == dt.date(2020, 3, 31)


def test_exclusions_are_counted(spark):
    out = al.align(debt_inputs(spark, {1: "provisional"}), er.DEBT_INTEREST.inputs, "lag_then_inner_join")
    assert [r.date.year for r in out.sample.collect()] == [2023]
    counts = {(r.input, r.reason): r.n for r in out.excluded.collect()}
    assert counts["interest_burden_change", "status"] == 1
    assert counts["interest_burden_change", "difference_unavailable"] == 2
    assert counts["lagged_primary_balance", "lag_unavailable"] == 1
    assert counts["lagged_primary_balance", "alignment"] == 2


def test_incomplete_quarter(spark):
    rows = [(dt.date(2024, m, 28), float(m), "actual") for m in range(1, 5)]
    df = spark.createDataFrame(rows, "date date, value double, status string")
    spec = (al.InputSpec("x", "monthly", "dependent", ("actual",)),)
    out = al.align({"x": df}, spec, "monthly_to_quarterly_mean")
    assert [(r.date, r.x) for r in out.sample.collect()] == [(dt.date(2024, 3, 31), 2.0)]
    assert [(r.reason, r.n) for r in out.excluded.collect()] == [("incomplete_quarter", 1)]


def test_bad_period_dates_and_duplicates_fail(spark):
    spec = (al.InputSpec("x", "annual", "dependent", ("actual",)),)
    june = spark.createDataFrame([(dt.date(2024, 6, 30), 1.0, "actual")], "date date, value double, status string")
    with pytest.raises(PySparkException, match="non-fiscal-year-end"):
        al.align({"x": june}, spec, "fiscal_year_end_inner_join").sample.collect()
    with pytest.raises(PySparkException, match="non-quarter-end"):
        al.align({"x": june.withColumn("date", F.lit("2024-05-31").cast("date"))}, spec, "quarter_end_inner_join").sample.collect()
    twice = june.union(june)
    with pytest.raises(PySparkException, match="duplicate periods"):
        al.align({"x": twice}, spec, "exact_date_inner_join").sample.collect()


def test_kept_plus_excluded_is_the_input(spark):
    rows = [(dt.date(2000 + i, 3, 31), None if i % 7 == 0 else float(i - 3), ("actual", "budget", "revised")[i % 3]) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, value double, status string")
    spec = al.InputSpec("x", "annual", "dependent", ("actual", "revised"), "log")
    marked = al.eligible_observations(df, spec, "2003-01-01")
    kept = marked.where("reason is null").count()
    assert kept + marked.where("reason is not null").count() == 40 and kept > 0


# --- regression ------------------------------------------------------------------

def ols_hac(y, x, lags):
    n, k = x.shape
    inv = np.linalg.inv(x.T @ x)
    b = inv @ x.T @ y
    u = y - x @ b
    g = x * u[:, None]
    s = g.T @ g
    for lag in range(1, lags + 1):
        gamma = g[lag:].T @ g[:-lag]
        s += (1 - lag / (lags + 1)) * (gamma + gamma.T)
    return b, np.sqrt(np.diag(inv @ s @ inv) * n / (n - k)), u, inv


def frame(spark, columns):
    n = len(next(iter(columns.values())))
    pdf = pd.DataFrame({"date": pd.date_range("2000-01-31", periods=n, freq="ME").date, **columns})
    return spark.createDataFrame(pdf)


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(7)
    x1, x2 = rng.normal(size=60).cumsum(), rng.normal(size=60) + 70
    y = 2 + 0.4 * x1 - 0.3 * x2 + rng.normal(size=60)
    return y, np.column_stack([np.ones(60), x1, x2]), frame(spark, {"y": y, "x1": x1, "x2": x2})


def test_slope_of_a_synthetic_series(spark):
    t = np.arange(60.0)
    fit = rg.ols(frame(spark, {"t": t, "y": 1.5 + 0.7 * t + 0.2 * np.sin(t / 2)}), "y", ("intercept", "t"))
    row = rg.hac(fit, 3).where("term = 't'").collect()[0]
    assert row.coef == pytest.approx(0.7, abs=5e-3) and row.df == 58 and row.ci_low < row.coef < row.ci_high and row.se > 0


@pytest.mark.parametrize("lags", [0, 1, 4])
def test_hac_matches_numpy(sample, lags):
    y, x, df = sample
    b, se, _, _ = ols_hac(y, x, lags)
    rows = {r.term: r for r in rg.hac(rg.ols(df, "y", ("intercept", "x1", "x2")), lags).collect()}
    for i, term in enumerate(("intercept", "x1", "x2")):
        assert rows[term].coef == pytest.approx(b[i], rel=1e-9) and rows[term].se == pytest.approx(se[i], rel=1e-8)
        assert rows[term].p_value == pytest.approx(nx.t_two_sided(b[i] / se[i], 57), rel=1e-6)


def test_diagnostics_match_numpy(sample):
    y, x, df = sample
    fit = rg.ols(df, "y", ("intercept", "x1", "x2"))
    b, _, u, inv = ols_hac(y, x, 0)
    h = np.einsum("ij,jk,ik->i", x, inv, x)
    cook = u**2 * h / (3 * (u @ u / 57) * (1 - h) ** 2)
    got = [r.cooks for r in rg.cooks(fit).orderBy("date").collect()]
    assert got == pytest.approx(list(cook), rel=1e-7)
    aux = np.column_stack([x, *[np.r_[np.zeros(i), u[:-i]] for i in (1, 2, 3)]])
    e = u - aux @ np.linalg.lstsq(aux, u, rcond=None)[0]
    lm = 60 * (1 - e @ e / (u @ u))
    bg = rg.breusch_godfrey(fit, 3).collect()[0]
    assert bg.lm == pytest.approx(lm, rel=1e-8) and bg.bg_p_value == pytest.approx(nx.chi2_tail(lm, 3), rel=1e-8)
    z = (x[:, 1:] - x[:, 1:].mean(0)) / x[:, 1:].std(0)
    cond = np.linalg.cond(np.column_stack([np.ones(60), z]))
    assert fit.groups.collect()[0].condition == pytest.approx(cond, rel=1e-8)


def adf_numpy(u):
    n = len(u)
    top = min(n // 2 - 1, math.ceil(12 * (n / 100) ** 0.25))
    d = np.diff(u)

    def regress(lag, first):
        t = np.arange(first, len(d))
        x = np.column_stack([u[t], *[d[t - i] for i in range(1, lag + 1)]])
        b = np.linalg.lstsq(x, d[t], rcond=None)[0]
        e = d[t] - x @ b
        return b, e @ e, len(t), np.linalg.inv(x.T @ x)

    aic = [(m * math.log(ss / m) + 2 * (lag + 1), lag) for lag in range(top + 1) for _, ss, m, _ in [regress(lag, top)]]
    lag = min(aic)[1]
    b, ss, m, inv = regress(lag, lag)
    return lag, b[0] / math.sqrt(inv[0, 0] * ss / (m - lag - 1))


def test_adf_matches_numpy(spark, sample):
    y, x, df = sample
    walk = np.random.default_rng(5).normal(size=80).cumsum()
    for rows, u in ((rg.ols(df, "y", ("intercept", "x1", "x2")).rows, ols_hac(y, x, 0)[2]), (frame(spark, {"resid": walk}), walk)):
        lag, tau = adf_numpy(u)
        got = rg.adf_gate(rg.adf(rows)).collect()[0]
        assert got.lag == lag and got.tau == pytest.approx(tau, rel=1e-7)
        assert got.stationary == (nx.tau_p_value(tau) < 0.10)


def test_rank_deficient_design_is_refused(spark):
    df = frame(spark, {"y": np.arange(8.0), "x": np.arange(8.0) ** 2, "x2": 2 * np.arange(8.0) ** 2})
    fit = rg.ols(df, "y", ("intercept", "x", "x2"))
    assert fit.groups.collect()[0].beta is None and fit.rows.count() == 0
    assert not rg.design_rank(df, ("intercept", "x", "x2")).collect()[0].full_rank
    with pytest.raises(ValueError, match="unique"):
        rg.ols(df, "y", ("x", "x"))


def test_tails():
    assert nx.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert nx.t_critical(57) == pytest.approx(2.002465459, abs=1e-7)
    assert nx.chi2_tail(7.814727903, 3) == pytest.approx(0.05, abs=1e-9)
    assert nx.chi2_tail(0.5, 4) == pytest.approx(0.973500979, abs=1e-8)
    assert nx.tau_p_value(-1.6168) == pytest.approx(0.10, abs=1e-3)
    assert nx.tau_p_value(-1.95) == pytest.approx(0.05, abs=2e-3)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.005]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)], "family string, analysis_key int, p_value double")
    got = {r.analysis_key: r.adjusted_p_value for r in ev.bh_adjust(df).collect()}
    assert got == {4: pytest.approx(0.025), 0: pytest.approx(0.025), 2: pytest.approx(0.05), 1: pytest.approx(0.05), 3: 1.0}


def test_benjamini_hochberg_of_one_large_family(spark):
    rng = np.random.default_rng(6)
    p = np.round(rng.uniform(size=3000) ** 2, 3)
    df = spark.createDataFrame([("hot", i, float(v)) for i, v in enumerate(p)] + [("small", 0, 0.2)], "family string, analysis_key int, p_value double")
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    want = np.empty(len(p))
    want[order] = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    for buckets in (1, 7, 1024):
        got = {r.analysis_key: r.adjusted_p_value for r in ev.bh_adjust(df, buckets=buckets).where("family = 'hot'").collect()}
        assert len(got) == len(p) and all(got[i] == pytest.approx(want[i], rel=1e-12) for i in range(len(p)))


def test_grades(spark):
    focal = spark.createDataFrame([(k, 1.0, p, "positive") for k, p in (("strong", 0.01), ("moderate", 0.01), ("mixed", 0.01), ("failed", 0.01), ("not", 0.5), ("mixed2", 0.5))],
                                  "analysis_key string, value double, adjusted_p_value double, expected string")
    diag = spark.createDataFrame([(k, k != "failed") for k in ("strong", "moderate", "mixed", "failed", "not", "mixed2")], "analysis_key string, passed boolean")
    checks = {"strong": ["s", "s"], "moderate": ["s", "n"], "mixed": ["s", None], "failed": ["s", "s"], "not": ["n", "n"], "mixed2": ["s", "n"]}
    robust = spark.createDataFrame([(k, None if c is None else 1.0, {"s": "supported", "n": "not_supported", None: "insufficient_data"}[c]) for k, cs in checks.items() for c in cs],
                                   "analysis_key string, value double, status string")
    got = {r.analysis_key: (r.status, r.grade) for r in ev.grade(focal, diag, robust).collect()}
    assert got == {"strong": ("supported", "strong"), "moderate": ("supported", "moderate"), "mixed": ("mixed", "limited"),
                   "failed": ("failed_diagnostics", "limited"), "not": ("not_supported", "limited"), "mixed2": ("mixed", "limited")}


def test_fiscal_report(spark):
    rng = np.random.default_rng(2)
    n = 46
    debt = 60 + np.arange(n) * 0.3 + rng.normal(size=n)
    balance = -3 + rng.normal(size=n)
    change = np.r_[0, 0.5 * (debt[:-1] - 60) + rng.normal(size=n - 1) * 0.3]
    values = {"interest_burden_change": 20 + change.cumsum(), "lagged_general_government_debt": debt, "lagged_primary_balance": balance}
    short = {k: annual(spark, v[:6], start=1980) for k, v in values.items()}
    good = er.run(er.DEBT_INTEREST, {k: annual(spark, v, start=1980) for k, v in values.items()})
    bad = er.run(er.BALANCE_DEBT, {"debt_change": short["lagged_general_government_debt"], "lagged_primary_balance": short["lagged_primary_balance"], "lagged_debt_change": short["lagged_general_government_debt"]})
    rows = {r.analysis_key: r for r in er.combine([good, bad]).collect()}
    main, failed = rows["debt-interest-burden-change"], rows["primary-balance-debt-change"]
    assert main.n == n - 1 and main.value == pytest.approx(0.5, abs=0.1) and main.checks == 5
    # The other family member enters with p = 1.
    assert main.adjusted_p_value == pytest.approx(min(2 * main.p_value, 1.0))
    assert (failed.status, failed.grade, failed.value) == ("insufficient_data", "not_assessed", None)
    assert good.robustness.where("value is not null").count() == 5 and good.diagnostics.count() == 5


def test_segmented_trend_report(spark):
    months = pd.date_range("2017-04-30", periods=108, freq="ME")
    rng = np.random.default_rng(9)
    v = np.exp(0.02 * np.arange(108) + 0.05 * np.sin(np.arange(108)) + rng.normal(size=108) * 0.03)
    df = spark.createDataFrame([(m.date(), float(x), "actual") for m, x in zip(months, v)], "date date, value double, status string")
    report = er.run(er.ADOPTION_TREND, {"log_upi_transactions_per_capita": df})
    shift = {r.term: r for r in report.estimates.collect()}
    assert set(shift) == {"monthly_trend", "level_shift", "slope_shift"} and not shift["level_shift"].is_focal
    row = er.combine([report]).collect()[0]
    assert row.n == 108 and row.value > 0 and row.p_value < 0.05 and row.checks == 4
    assert report.robustness.where("value is not null").count() == 4
    t = np.arange(108.0)
    idx = np.array([m.year * 12 + m.month for m in months]); cut = 2020 * 12 + 4
    x = np.column_stack([np.ones(108), t, *[(months.month == m).astype(float) for m in range(2, 13)], idx >= cut, np.maximum(0, idx - cut)])
    b, se, _, _ = ols_hac(np.log(v), x.astype(float), 12)
    assert row.value == pytest.approx(100 * np.expm1(12 * b[1]), rel=1e-8)
    assert shift["level_shift"].value == pytest.approx(100 * np.expm1(b[-2]), rel=1e-6)
    assert shift["slope_shift"].value == pytest.approx(100 * np.expm1(12 * b[-1]), rel=1e-6)
    assert row.se == pytest.approx(abs(1200 * np.exp(12 * b[1]) * se[1]), rel=1e-6)


def test_incomplete_groups_are_refused_and_short_groups_stay(spark):
    import datetime as dt

    rng = np.random.default_rng(3)
    rows = []
    for name, n in (("long", 300), ("short", 14), ("holed", 40), ("tiny", 2)):
        u = 0.0
        for i in range(n):
            u = 0.5 * u + float(rng.standard_normal())
            x = None if name == "holed" and i == 7 else float(i)
            rows.append((name, dt.date(2000, 1, 1) + dt.timedelta(days=31 * i), 1.0 + 2.0 * i, x, u))
    df = spark.createDataFrame(rows, "grp string, date date, y double, x double, u double")
    groups = {r.grp: r for r in rg.ols(df, "y", ("intercept", "x"), ("grp",)).groups.collect()}
    assert groups["holed"].beta is None
    assert np.allclose(groups["long"].beta, [1.0, 2.0]) and np.allclose(groups["short"].beta, [1.0, 2.0])
    together = {r.grp: r for r in rg.adf(df, "u", ("grp",)).collect()}
    assert set(together) == {"long", "short", "holed", "tiny"}
    for name in ("long", "short"):
        alone = rg.adf(df.where(f"grp = '{name}'"), "u", ("grp",)).first()
        assert together[name].lag == alone.lag and abs(together[name].tau - alone.tau) < 1e-9


def test_reversed_event_window_gives_nothing(spark):
    import datetime as dt

    from tidemark.operators import market as mk

    prices = spark.createDataFrame([(dt.date(2024, 1, k), "M", float(k)) for k in range(1, 20)], "date date, market string, price double")
    events = spark.createDataFrame([("ok", dt.date(2024, 1, 2), dt.date(2024, 1, 5)), ("back", dt.date(2024, 1, 9), dt.date(2024, 1, 3))],
                                   "event_id string, start_date date, end_date date")
    assert [r.event_id for r in mk.event_window_change(prices, events).collect()] == ["ok"]


def test_large_means_lose_no_digits(spark):
    """Columns whose mean is a million times their spread, against the centred fit in numpy."""
    rng = np.random.default_rng(21)
    x1, x2 = 1e6 + rng.normal(size=200), 5e5 + rng.normal(size=200).cumsum()
    y = 3e6 + 0.4 * x1 - 0.3 * x2 + rng.normal(size=200)
    df = frame(spark, {"y": y, "x1": x1, "x2": x2}).repartition(5)
    c1, c2 = (np.array([math.fsum(v) / 200]) for v in (x1, x2))
    z = np.column_stack([np.ones(200), x1 - c1, x2 - c2])
    b, se, u, inv = ols_hac(y - 3e6, z, 3)
    fit = rg.ols(df, "y", ("intercept", "x1", "x2"))
    rows = {r.term: r for r in rg.hac(fit, 3).collect()}
    for i, term in ((1, "x1"), (2, "x2")):
        assert rows[term].coef == pytest.approx(b[i], rel=1e-9) and rows[term].se == pytest.approx(se[i], rel=1e-9)
    assert rows["intercept"].coef == pytest.approx(3e6 + b[0] - b[1] * c1[0] - b[2] * c2[0], rel=1e-9)
    h = np.einsum("ij,jk,ik->i", z, inv, z)
    cook = u**2 * h / (3 * (u @ u / 197) * (1 - h) ** 2)
    got = rg.cooks(fit).orderBy("date").collect()
    assert [r.leverage for r in got] == pytest.approx(list(h), rel=1e-9) and [r.cooks for r in got] == pytest.approx(list(cook), rel=1e-7)
    cond = np.linalg.cond(np.column_stack([np.ones(200), z[:, 1] / z[:, 1].std(), z[:, 2] / z[:, 2].std()]))
    assert rg.condition_number(df, ("x1", "x2")).first().condition == pytest.approx(cond, rel=1e-9)
    assert rg.design_rank(df, ("intercept", "x1", "x2")).first().full_rank


def test_constant_columns_are_rank_deficient(spark):
    df = frame(spark, {"y": np.arange(9.0), "x": np.full(9, 1e6 / 3), "t": np.arange(9.0) ** 2}).repartition(4)
    assert rg.ols(df, "y", ("intercept", "x", "t")).groups.first().rank == 2
    assert rg.ols(df, "y", ("x", "t")).groups.first().rank == 2
    assert rg.ols(df, "y", ("intercept",)).groups.first().beta == pytest.approx([4.0])
