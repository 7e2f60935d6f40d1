"""Alignment, bridges and documents by group: each group gives what it gives alone."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import alignment as al
from tidemark.operators import reshape as rs
from tidemark.operators import summaries as sm
from tidemark.operators import vintages as vt

SPECS = (
    al.InputSpec("a", "monthly", "dependent", ("actual",), "log_difference"),
    al.InputSpec("b", "monthly", "focal", ("actual", "revised"), "level", 2),
    al.InputSpec("c", "monthly", "control", ("actual", "revised"), "difference"),
)


def month_ends(n):
    return [dt.date(2000 + k // 12 + (k % 12 == 11), (k + 1) % 12 + 1, 1) - dt.timedelta(days=1) for k in range(n)]


@pytest.fixture(scope="module")
def inputs(spark):
    rng = random.Random(4)
    out = {}
    for name in "abc":
        rows = [(e, d, rng.choice([None, -1.0, *[5 + rng.random()] * 12]), rng.choice(["actual"] * 8 + ["revised", "budget"]))
                for e in ("x", "y", "z") for d in month_ends(60) if rng.random() < 0.95]
        # One group has nothing of one input.
        out[name] = spark.createDataFrame([r for r in rows if (name, r[0]) != ("c", "z")], "entity string, date date, value double, status string")
    return out


@pytest.mark.parametrize("strategy", ["lag_then_inner_join", "monthly_to_quarterly_mean"])
def test_each_group_aligns_as_it_does_alone(inputs, strategy):
    both = al.align(inputs, SPECS, strategy, "2000-06-30", by=("entity",))
    sample, excluded = both.sample.collect(), both.excluded.collect()
    for entity in ("x", "y", "z"):
        alone = al.align({k: v.where(F.col("entity") == entity).drop("entity") for k, v in inputs.items()}, SPECS, strategy, "2000-06-30")
        for got, want in ((sample, alone.sample.collect()), (excluded, alone.excluded.collect())):
            assert Counter(tuple(r)[1:] for r in got if r.entity == entity) == Counter(map(tuple, want))
    assert {r.entity for r in sample} == ({"x", "y"} if "lag" in strategy else {r.entity for r in sample} - {"z"}) and {r.entity for r in excluded} == {"x", "y", "z"}


def test_kept_and_excluded_are_all_rows_of_a_group(inputs):
    prepared = al.prepare(inputs["b"], SPECS[1], by=("entity",))
    n = {r.entity: r.n for r in inputs["b"].groupBy("entity").agg(F.count("*").alias("n")).collect()}
    assert {r.entity: r.n for r in prepared.groupBy("entity").agg(F.count("*").alias("n")).collect()} == n


def test_a_lag_never_takes_the_date_of_another_group(spark):
    rows = [("x", dt.date(2000, 1, 31)), ("y", dt.date(2000, 3, 31))]
    df = spark.createDataFrame([(*r, 1.0, r[1]) for r in rows], "entity string, date date, value double, source_date date")
    assert [r.date for r in al.period_lag(df, df, 2, "monthly", ("entity",)).collect()] == [None, None]
    assert Counter(r.date for r in al.period_lag(df, df, 2, "monthly").collect()) == {dt.date(2000, 3, 31): 1, None: 1}


def test_windows_are_dealt_by_the_group(inputs):
    plan = al.prepare(inputs["c"], SPECS[2], by=("entity",))._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_bridge_scatter_and_latest_points_by_group(spark):
    d, e = dt.date(2001, 3, 31), dt.date(2002, 3, 31)
    left = spark.createDataFrame([("x", d, "s", 4.0, "actual"), ("y", d, "s", 6.0, "actual")], "entity string, date date, indicator string, value double, status string")
    right = spark.createDataFrame([("y", d, 3.0, "revised"), ("y", e, 1.0, "actual")], "entity string, date date, value double, status string")
    got = Counter(map(tuple, vt.bridge(left, right, "r", ("entity",)).select("entity", "indicator", "value", "status").collect()))
    assert got == Counter([("x", "s", 4.0, "actual"), ("y", "s", 6.0, "actual"), ("y", "r", 2.0, "revised")])
    points = sm.scatter_points(left, right, right, ("entity", "date"))
    assert [tuple(r) for r in points.collect()] == [("y", d, 6.0, 3.0, 3.0)]
    assert [tuple(r) for r in sm.scatter_reference(points, ("entity",)).collect()] == [("y", 6.0, 3.0, 3.0, 3.0)]
    latest = rs.latest_points(right.withColumn("indicator", F.lit("q")), by=("entity",)).collect()
    assert [(r.entity, r.date, r.value) for r in latest] == [("y", e, 1.0)]
    wide = rs.outer_align({"l": left, "r": right}, ("entity", "date")).collect()
    assert {(r.entity, r.date): (r.l, r.r) for r in wide} == {("x", d): (4.0, None), ("y", d): (6.0, 3.0), ("y", e): (None, 1.0)}


def test_a_document_for_each_group(spark):
    records = spark.createDataFrame([("x", "k2", dt.date(2001, 1, 31), 2.0), ("x", "k2", dt.date(2000, 1, 31), 1.0), ("y", "k1", dt.date(2002, 1, 31), 3.0)],
                                    "entity string, indicator string, date date, value double").select(
        "*", F.lit("actual").alias("status"), F.lit("p").alias("period_label"))
    definitions = spark.createDataFrame([(2, "k1"), (1, "k2")], "ordinal int, key string").select(
        "*", F.upper("key").alias("label"), F.lit("IND").alias("entity"), F.lit("u").alias("unit"), F.lit(False).alias("is_derived"))
    docs = {r.entity: json.loads(r.document) for r in rs.to_dated_multi_series(records, definitions, {"frequency": "monthly"}, ("entity",)).collect()}
    assert docs["x"]["metadata"] == {"frequency": "monthly", "start_date": "2000-01-31", "end_date": "2001-01-31", "series_order": ["k2", "k1"]}
    assert [v["value"] for v in docs["x"]["series"]["k2"]["values"]] == [1.0, 2.0] and docs["x"]["series"]["k1"]["values"] == []
    assert docs["y"]["series"]["k1"]["values"][0]["value"] == 3.0 and docs["y"]["series"]["k1"]["label"] == "K1"
