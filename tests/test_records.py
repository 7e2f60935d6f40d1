"""Scalars, fiscal periods, vintages, flows, grids and quality gates."""

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions import scalars as sc
from tidemark.operators import growth as gr
from tidemark.operators import panel as pn
from tidemark.operators import quality as ql
from tidemark.operators import reshape as rs
from tidemark.operators import summaries as sm
from tidemark.operators import vintages as vt
from tidemark.plans import products as pr
from tidemark.sources import documents as dc
from tidemark.sources import grids as gd
from tidemark.sources import landing as ld
from tidemark.sources import sinks as sk
from tidemark.session import scratch_path, settle


def one(df):
    return df.collect()[0]


@pytest.mark.parametrize("text,expected", [
    ("1.23456", 1.2346), ("abc", None), (None, None), ("nan", None), ("inf", None), ("1.5d", None), (" 7 ", 7.0), ("1e3", 1000.0)])
def test_clean_double(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    assert one(df.select(sc.clean_double("v", text=True).alias("x"))).x == expected


@pytest.mark.parametrize("text,expected", [
    ("1,234.5", 1234.5), ("(12.5)", -12.5), ("-", None), ("..", None), ("…", None), ("—", None), ("n/a", None), ("-3", -3.0)])
def test_parse_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "v string")
    assert one(df.select(sc.parse_number("v").alias("x"))).x == expected


def test_non_finite_numbers_become_null(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "v double")
    assert [r.x for r in df.select(sc.finite("v").alias("x")).collect()] == [None, None, None, 2.0]


def test_fiscal_period(spark):
    df = spark.createDataFrame([(dt.date(2025, 3, 31),), (dt.date(2025, 4, 1),)], "d date")
    rows = df.select(cal.fy_end("d").alias("fy"), cal.fy_label(cal.fy_start("d")).alias("label")).collect()
    assert [(r.fy, r.label) for r in rows] == [(2025, "FY2024-25"), (2026, "FY2025-26")]
    q = one(spark.range(1).select(cal.fiscal_quarter_end(F.lit(2024), F.lit(4)).alias("e"), cal.fiscal_quarter_start(F.lit(2024), F.lit(4)).alias("s")))
    assert (q.s, q.e) == (dt.date(2025, 1, 1), dt.date(2025, 3, 31))
    with pytest.raises(PySparkException, match="Quarter must be between"):
        spark.range(1).select(cal.fiscal_quarter_start(F.lit(2024), F.lit(5))).collect()


def test_labels(spark):
    df = spark.createDataFrame([("Apr-24", "April-June 2024", " 3. Roads "), ("September 2023", "May-June 2024", "Total")], "m string, q string, s string")
    rows = df.select(cal.parse_month("m").alias("m"), cal.parse_quarter_label("q").alias("q"), sc.norm_label("s").alias("s")).collect()
    assert [tuple(r) for r in rows] == [(dt.date(2024, 4, 30), dt.date(2024, 6, 30), "roads"), (dt.date(2023, 9, 30), None, "total")]


def test_vintages_execute_at_ninety(spark):
    snaps = spark.createDataFrame([(2024, 80.0, 95.0, 100.0, 400.0), (2025, 85.0, 98.0, 110.0, 420.0), (2026, 90.0, 99.0, 120.0, 450.0)],
                                  "edition int, actual_capex double, prior_revised_capex double, current_budget_capex double, actual_total_expenditure double")
    v = {r.fy: r for r in vt.assemble_vintages(snaps).collect()}
    assert v[2024].budget == 100 and v[2024].actual == 90 and v[2024].revised == 98 and v[2026].actual is None
    assert {r.fy: r.execution_ratio for r in vt.execution_ratio(vt.assemble_vintages(snaps)).collect()} == {2024: pytest.approx(90.0)}
    records = pr.execution(snaps).where("indicator = 'capex_execution_ratio'").collect()
    assert [(r.period_label, r.value) for r in records] == [("FY2024-25", pytest.approx(90.0))]


def test_newest_edition_wins(spark):
    snaps = spark.createDataFrame([(2024, None, None, 100.0, None), (2024 + 1, None, 111.0, None, None)],
                                  "edition int, actual_capex double, prior_revised_capex double, current_budget_capex double, actual_total_expenditure double")
    v = {r.fy: r for r in vt.assemble_vintages(snaps).collect()}
    assert v[2024].budget == 100 and v[2024].revised == 111


def test_upsert_ties_go_to_the_batch(spark):
    schema = "d string, v double, ts int"
    archive = spark.createDataFrame([("a", 1.0, 5), ("b", 1.0, 5), ("c", 1.0, 9)], schema)
    batch = spark.createDataFrame([("a", 2.0, 5), ("b", 2.0, 6), ("c", 2.0, 8), ("d", 2.0, 1)], schema)
    assert {r.d: r.v for r in vt.upsert_latest(archive, batch, ["d"], "ts").collect()} == {"a": 2.0, "b": 2.0, "c": 1.0, "d": 2.0}


def test_rolling_flows_need_twelve_consecutive_months(spark):
    rows = [(dt.date(2024 + m // 12, m % 12 + 1, 15), c, s * 10.0) for m in range(13) for c, s in (("DII", 1), ("FPI", -1))]
    flows = spark.createDataFrame(rows, "date date, category string, net double")
    out = sm.capital_resilience(sm.monthly_flows(flows)).orderBy("date").collect()
    assert out[10].dii_rolling_12m is None and out[11].dii_rolling_12m == 120 and out[11].fpi_rolling_12m == -120
    assert out[11].dii_offset_ratio == 1
    gap = flows.where("date <> date'2024-06-15'")
    assert all(r.dii_rolling_12m is None for r in sm.capital_resilience(sm.monthly_flows(gap)).collect())


def test_growth_gap_refuses_non_positive_levels(spark):
    left = spark.createDataFrame([(2020, 100.0, "actual"), (2021, 110.0, "provisional")], "year int, value double, status string")
    right = spark.createDataFrame([(2020, 50.0, "actual"), (2021, 52.5, "revised")], "year int, value double, status string")
    row = one(gr.growth_gap(left, right))
    assert row.gap == pytest.approx(5.0) and row.status == "provisional"
    with pytest.raises(PySparkException, match="must be positive"):
        gr.growth_gap(left, right.withColumn("value", F.lit(0.0))).collect()


def test_median_growth_of_a_group(spark):
    rows = [(c, "capital_goods", y, 100.0 if y == 2023 else 110.0, 1.0, 1.0, 1.0, 1.0) for c in "abcd" for y in (2023, 2024)]
    df = spark.createDataFrame(rows, "company_key string, grp string, fy int, revenue double, ebitda double, capex double, net_ppe double, debt double")
    out = pr.corporate_fundamentals(df).where("metric = 'revenue_growth'").collect()
    assert [(r.fy, r.value) for r in out] == [(2024, pytest.approx(10.0))]


def test_two_way_effects_match_a_dummy_regression(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    rows = [(f"s{i}", 2000 + t, float(x), float(0.5 * x + i + t + rng.normal())) for i in range(16) for t in range(8) for x in [rng.normal()]]
    est = one(pn.panel_gate(pn.two_way_fe(spark.createDataFrame(rows, "state string, year int, x double, y double"))))
    s = np.array([int(r[0][1:]) for r in rows]); t = np.array([r[1] - 2000 for r in rows])
    x, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    design = np.column_stack([x, np.eye(16)[s], np.eye(8)[t][:, 1:]])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert est.coefficient == pytest.approx(beta[0], abs=1e-10) and est.eligible
    xw = x - np.array([x[s == i].mean() for i in s]) - np.array([x[t == i].mean() for i in t]) + x.mean()
    yw = y - np.array([y[s == i].mean() for i in s]) - np.array([y[t == i].mean() for i in t]) + y.mean()
    score = np.array([(xw * (yw - beta[0] * xw))[s == i].sum() for i in range(16)])
    assert est.clustered_se == pytest.approx(np.sqrt(16 / 15 * (score**2).sum()) / (xw**2).sum())


def test_labelled_amounts(spark):
    texts = ["Capital   Expenditure2 1,051,953 2,000.5 3 4 tail", "CAPITAL OUTLAY 10 20 30 40", "Capital Expenditure 5 6"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = dc.extract_labelled_amounts(df, "text", ("Capital Expenditure", "Capital Outlay"), 4).collect()
    assert [r.amounts for r in rows] == [[1051953.0, 2000.5, 3.0, 4.0], [10.0, 20.0, 30.0, 40.0], None]


def test_ragged_grid(spark):
    rows = [("s", 1, ["Sector", "2020", "2021"]), ("s", 2, ["1. Roads"]), ("s", 3, ["on", "5", None]), ("s", 4, ["late", "x", "7"]), ("s", 5, ["Note: a", "9"])]
    grid = spark.createDataFrame(rows, "sheet_id string, row_no int, cells array<string>")
    out = gd.grid_label_blocks(grid, gd.cell(0).rlike(r"^\d+\."), ("on", "late")).collect()
    assert sorted((r.metric, r.pos, r.value) for r in out) == [("late", 1, 7.0), ("on", 0, 5.0)]
    long = gd.unpivot_grid(grid, gd.cell(0) == "Sector").collect()
    assert sorted((r.label, r.period, r.value) for r in long) == [("late", "2021", 7.0), ("on", "2020", 5.0)]


def test_conflicting_duplicates_fail(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert sorted(ld.dedupe_consistent(df, ["k"]).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(PySparkException, match="Conflicting rows"):
        ld.dedupe_consistent(df.union(spark.createDataFrame([("b", 3)], "k string, v int")), ["k"]).collect()


def test_dense_years_and_unknown_ids(spark):
    df = spark.createDataFrame([("IND", 2020, 1.0), ("IND", 2022, 3.0)], "entity string, year int, value double")
    assert [(r.year, r.value) for r in rs.densify_years(df, 2020, 2022).orderBy("year").collect()] == [(2020, 1.0), (2021, None), (2022, 3.0)]
    registry = spark.createDataFrame([("a", 1)], "id string, ordinal int")
    with pytest.raises(PySparkException, match="Unregistered id"):
        rs.order_by_registry(spark.createDataFrame([("b",)], "id string"), registry).collect()


def test_quality_gates_raise_and_pass(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    with pytest.raises(ql.DataQualityError, match="duplicate"):
        ql.require_clean(ql.check_unique(df, ["k"]), "duplicate keys")
    ql.require_clean(ql.check_unique(df.limit(1), ["k"]), "duplicate keys")
    corr = spark.createDataFrame([(1.2,), (None,), (-1.0,)], "corr double")
    assert [r["corr"] for r in ql.check_correlation(corr).collect()] == [1.2]
    text = spark.createDataFrame([("Debt CAUSED growth",), ("because of it",)], "t string")
    assert [r.pattern for r in ql.check_text(text, "t").collect()] == [r"\bcaused\b"]


def test_copies_and_scratch(spark):
    df = spark.range(50).select("id", (F.col("id") * 1.5).alias("v"))
    root = scratch_path(spark, "copies")
    assert sk.write_outputs({"a": df, "b": df}, [f"{root}/x", f"{root}/y"], target="a") == ["a"]
    assert one(sk.verify_copies(spark, f"{root}/x/a", f"{root}/y/a")).same
    df.limit(49).write.parquet(f"{root}/z")
    assert not one(sk.verify_copies(spark, f"{root}/x/a", f"{root}/z")).same
    with pytest.raises(ValueError, match="Unknown output"):
        sk.write_outputs({"a": df}, [root], target="nope")
    assert settle(df).count() == 50


def test_bridge_keeps_left_rows(spark):
    schema = "date date, indicator string, value double, status string"
    left = spark.createDataFrame([(dt.date(2020, 3, 31), "s", 10.0, "actual"), (dt.date(2021, 3, 31), "s", None, "actual"), (dt.date(2022, 3, 31), "s", 5.0, "actual")], schema)
    right = spark.createDataFrame([(dt.date(2020, 3, 31), "i", 4.0, "revised"), (dt.date(2021, 3, 31), "i", 4.0, "actual"), (dt.date(2022, 3, 31), "i", 0.0, "actual")], schema)
    rows = vt.bridge(left, right, "r").collect()
    assert len(rows) == 4 and [(r.value, r.status) for r in rows if r.indicator == "r"] == [(2.5, "revised")]


def test_canonical_order(spark):
    df = spark.createDataFrame([(dt.date(2021, 1, 1), "b", "x"), (dt.date(2020, 1, 1), "b", "y"), (dt.date(2020, 1, 1), "a", "z")], "date date, indicator string, entity string")
    assert [r.entity for r in rs.canonical_order(df).collect()] == ["z", "y", "x"]


def test_exact_median_with_ties_signs_and_a_hot_group(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    groups = {"hot": rng.standard_t(2, 4001) * 50, "even": rng.normal(size=10), "ties": np.array([1.0, 1.0, 1.0, 9.0]), "one": np.array([-3.0]), "zero": np.array([-2.0, 0.0, 0.0, 5.0, 7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("hot", None)], "k string, v double")
    got = {r.k: r.m for r in sm.exact_median(df, "v", ["k"], "m").collect()}
    assert got == {k: pytest.approx(float(np.median(v))) for k, v in groups.items()}


def test_order_check_across_chunks(spark):
    rows = [("a", i, dt.date(2020, 1, 1) + dt.timedelta(days=d)) for i, d in enumerate([0, 1, 2, 2, 4, 3, 7, 6, 9])]
    df = spark.createDataFrame(rows, "k string, pos int, date date")
    for chunk in (2, 3, 100):
        assert sorted(r.pos for r in ql.check_ordered(df, ["k"], "pos", chunk=chunk).collect()) == [3, 5, 7]


# --- streams and landings ------------------------------------------------------------

def flow_rows(spark, rows):
    from tidemark.streaming import flows as st

    stamped = [(dt.date.fromisoformat(d), "FPI", 1.0, 1.0, net, dt.datetime.fromisoformat(at)) for d, net, at in rows]
    return spark.createDataFrame(stamped, st.LANDED_FLOWS)


def test_upsert_survives_replay_and_restart(spark, tmp_path):
    from tidemark.streaming import flows as st

    table, keys = str(tmp_path / "flows"), ("date", "category")

    def put(source, batch, rows):
        st.upsert_batch(flow_rows(spark, rows), batch, source, table, st.LANDED_FLOWS, keys, "retrieved_at")

    def live():
        return {str(r.date): r.net for r in st.current_rows(spark, table, st.LANDED_FLOWS).collect()}

    put("a", 0, [("2024-01-01", 1.0, "2024-03-01"), ("2024-01-02", 2.0, "2024-03-01"), ("2024-02-01", 3.0, "2024-03-01")])
    revised = [("2024-01-02", 20.0, "2024-03-02")]
    put("a", 1, revised)
    put("a", 1, revised)
    assert live() == {"2024-01-01": 1.0, "2024-01-02": 20.0, "2024-02-01": 3.0}
    put("b", 0, [("2024-01-03", 30.0, "2024-03-03")])  # a new checkpoint counts batches from 0 again
    put("a", 1, revised)
    expected = {"2024-01-01": 1.0, "2024-01-02": 20.0, "2024-01-03": 30.0, "2024-02-01": 3.0}
    assert live() == expected
    assert st.vacuum(spark, table) == 2
    assert live() == expected


def test_landing_keeps_late_rows_once(spark, tmp_path):
    from tidemark.streaming import flows as st

    table = str(tmp_path / "landed")
    first = [("2024-03-01", 1.0, "2024-06-01"), ("2024-03-02", 2.0, "2024-06-01")]
    late = [("2020-01-01", 3.0, "2020-01-01"), *first]
    for batch, rows in ((0, first), (1, late), (1, late)):
        st.land_batch(flow_rows(spark, rows), batch, "a", table, st.LANDED_FLOWS)
    assert sorted(r.net for r in st.landed_rows(spark, table).collect()) == [1.0, 2.0, 3.0]


def test_monthly_flows_keep_late_months(spark, tmp_path):
    from tidemark.streaming import flows as st

    source, table = str(tmp_path / "in"), str(tmp_path / "monthly")
    for day in ("2024-09-01", "2024-02-01", "2024-09-02"):
        flow_rows(spark, [(day, 7.0, "2024-10-01")]).coalesce(1).write.mode("append").json(source)
        st.stream_monthly_flows(st.read_stream(spark, source), table, str(tmp_path / "state")).awaitTermination()
    got = {str(r.month): r.net for r in st.monthly_flows(spark, table).collect()}
    assert got == {"2024-09-01": 14.0, "2024-02-01": 7.0}


def test_latest_landing_keeps_all_part_files(spark):
    from tidemark.sources.landing import latest_landing

    job = "/part-0000{}-aaaaaaaa-bbbb-cccc-dddd-eeeeeeeeeee{}-c000.json"
    rows = [("k", "2024-01-02", 5, "/x" + job.format(0, 1), 1), ("k", "2024-01-02", 6, "/x" + job.format(1, 1), 2),
            ("k", "2024-01-02", 4, "/x" + job.format(0, 2), 3), ("k", "2024-01-01", 9, "/y.json", 4)]
    df = spark.createDataFrame(rows, "key string, date_dir string, file_time int, file_path string, value int")
    assert sorted(r.value for r in latest_landing(df, ["key"]).collect()) == [1, 2]


def test_compacted_monthly_flows_agree_and_replay_safely(spark, tmp_path):
    import os

    from tidemark.streaming import flows as st

    table = str(tmp_path / "monthly")

    def put(source, batch, *rows):
        st.monthly_batch(flow_rows(spark, [(day, net, "2024-10-01") for day, net in rows]), batch, source, table)

    def live():
        return {str(r.month): (r.net, str(r.date)) for r in st.monthly_flows(spark, table).collect()}

    def folders():
        return sorted(f"{s}/{b}" for s in os.listdir(table) if s.startswith("source") for b in os.listdir(f"{table}/{s}"))

    assert st.compact_monthly_flows(spark, table) is None and live() == {}
    for n, day in enumerate(("2024-09-01", "2024-02-01", "2024-09-03")):
        put("a", n, (day, 7.0))
    put("b", 0, ("2024-09-02", 1.0))
    want = {"2024-09-01": (15.0, "2024-09-03"), "2024-02-01": (7.0, "2024-02-01")}
    assert live() == want
    assert st.compact_monthly_flows(spark, table) == 0 and live() == want
    assert st.compact_monthly_flows(spark, table) == 0  # nothing new to merge
    assert st.vacuum_monthly_flows(spark, table) == 2 and live() == want
    assert folders() == ["source=a/batch=2", "source=b/batch=0"]
    put("a", 0, ("2024-09-01", 7.0))  # held by the base
    put("a", 2, ("2024-09-03", 7.0))  # the newest batch, not held
    assert live() == want and folders() == ["source=a/batch=2", "source=b/batch=0"]
    # An interrupted run has written a base without publishing it.
    flow_rows(spark, [("2024-09-01", 99.0, "2024-10-01")]).selectExpr("date as month", "category", "net", "date").write.parquet(f"{table}/_base/version=1")
    assert live() == want
    put("a", 3, ("2024-02-09", 2.0))
    want["2024-02-01"] = (9.0, "2024-02-09")
    assert live() == want and st.compact_monthly_flows(spark, table) == 1 and live() == want
    assert st.vacuum_monthly_flows(spark, table) == 2 and live() == want  # a batch and the older base
