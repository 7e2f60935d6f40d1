"""Range-split ranks against pandas, with one key that holds most rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import market as mk
from tidemark.operators import ranks


@pytest.fixture(scope="module")
def hot():
    rng = random.Random(3)
    rows = [("hot", float(rng.randrange(50)), i) for i in range(3000)] + [("hot", 7.0, 10_000 + i) for i in range(2000)]
    rows += [(k, float(rng.randrange(5)), i) for k in ("a", "b", None) for i in range(40)] + [("a", None, 99)]
    rng.shuffle(rows)
    return rows


def test_row_numbers_of_a_hot_key_use_several_ranges(spark, hot):
    df = spark.createDataFrame(hot, "k string, v double, id long").repartition(6)
    got = ranks.numbered(df, ["k"], [F.desc("v"), "id"]).toPandas()
    assert len(got) == len(hot)
    for key, rows in got.groupby("k", dropna=False):
        rows = rows.sort_values("place")
        assert rows.place.tolist() == list(range(1, len(rows) + 1)), key
        wanted = rows.sort_values(["v", "id"], ascending=[False, True], na_position="last")
        assert wanted.id.tolist() == rows.id.tolist()
    dealt = df.repartitionByRange(8, "k", F.desc("v"), "id").where("k = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert dealt > 3


def test_values_are_ranked_as_pandas_does(spark, hot):
    df = spark.createDataFrame(hot, "k string, v double, id long")
    got = ranks.ranked_values(df, ["k"], "v").toPandas()
    rows = pd.DataFrame(hot, columns=["k", "v", "id"]).dropna(subset=["v"])
    rows["k"] = rows.k.fillna("none")
    rows["avg"] = rows.groupby("k").v.rank("average")
    rows["min"] = rows.groupby("k").v.rank("min")
    wanted = {(r.k, r.v): (r["min"], r.avg) for _, r in rows.iterrows()}
    assert {(r.k or "none", r.v): (r.min_rank, r.avg_rank) for _, r in got.iterrows()} == wanted


def test_totals_without_keys_and_of_nothing(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("w"))
    got = ranks.running_total(df, [], [F.desc("id")], "w", "t", exclusive=True).orderBy(F.desc("id")).collect()
    total = 0
    for row in got:
        assert row.t == total
        total += row.w
    assert ranks.numbered(df.where("false"), [], ["id"]).count() == 0


def test_many_markets_are_ranked_without_one_task_per_metric(spark):
    rows = [(f"m{i:05d}", (i * 37) % 1000 / 10, (i * 11) % 500 / 10) for i in range(2000)]
    summary = spark.createDataFrame(rows, "market string, cagr double, annual_volatility double")
    got = mk.metric_rankings(summary, ("cagr", "annual_volatility")).toPandas()
    by = pd.DataFrame(rows, columns=["market", "cagr", "annual_volatility"])
    high = by.sort_values(["cagr", "market"], ascending=[False, True]).market.tolist()
    low = by.sort_values(["annual_volatility", "market"]).market.tolist()
    assert got[got.metric == "cagr"].sort_values("rank").market.tolist() == high
    assert got[got.metric == "annual_volatility"].sort_values("rank").market.tolist() == low
