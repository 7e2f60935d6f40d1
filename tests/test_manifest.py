"""What has landed, by shard: pruned reads, replays, merging."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import manifest as mf
from tidemark.streaming import flows as st


def rows(spark, days, net=1.0):
    return spark.createDataFrame([(dt.date.fromisoformat(d), "c", net) for d in days], "date date, category string, net double")


def land(spark, df, path, batch, source="a"):
    new = mf.unseen(df, path, source, str(batch), "date").persist()
    mf.record(new, path, source, str(batch))
    return new.count()


@pytest.fixture
def history(spark, tmp_path):
    """Two years of daily rows, landed month by month."""
    path = str(tmp_path / "hashes")
    for batch in range(4):
        days = [(dt.date(2020, 1 + 3 * batch, 1) + dt.timedelta(days=k)).isoformat() for k in range(60)]
        assert land(spark, rows(spark, days), path, batch) == 60
    return path


def test_a_batch_reads_its_own_months_only(spark, history):
    everything = spark.read.schema(mf.SHARDED).parquet(history).inputFiles()
    batch = rows(spark, ["2020-04-03", "2020-04-04", "2021-07-01"])
    shards = [r.shard for r in mf.marked(batch, date="date").select("shard").distinct().collect()]
    read = mf.held(spark, history, shards).inputFiles()
    assert 0 < len(read) <= 2 < len(everything)
    assert all("shard=2020-04/" in f for f in read)
    plan = mf.unseen(batch, history, "a", "9", "date")._jdf.queryExecution().executedPlan().toString()
    assert "2020-07" not in plan and "PathFilters" not in plan
    assert land(spark, batch, history, 9) == 1


def test_a_month_without_history_reads_nothing(spark, history):
    assert mf.held(spark, history, ["1999-01"]).inputFiles() == []
    assert land(spark, rows(spark, ["1999-01-05", "1999-01-05"]), history, 5) == 1


def test_a_batch_runs_again(spark, history):
    days = ["2020-04-03", "2020-12-24"]
    assert [land(spark, rows(spark, days), history, 7) for _ in range(2)] == [1, 1]
    assert land(spark, rows(spark, days), history, 7, source="b") == 0


def test_merged_shards_say_the_same(spark, history):
    for batch in range(10, 20):
        land(spark, rows(spark, ["2020-04-03"], float(batch)), history, batch)
    every = ["2020-04", "2020-05", "1999-01"]
    before = {tuple(r) for r in mf.held(spark, history, every).select("sha256", "source", "batch").collect()}
    merged = mf.compact(spark, history, every, many=2)
    assert merged > 0 and {tuple(r) for r in mf.held(spark, history, every).select("sha256", "source", "batch").collect()} == before
    assert mf.compact(spark, history, every, many=2) == 0
    assert land(spark, rows(spark, ["2020-04-03"], 12.0), history, 12) == 1, "a merged batch runs again"
    assert land(spark, rows(spark, ["2020-04-03"], 12.0), history, 99) == 0


def test_null_dates_and_no_date(spark, tmp_path):
    df = spark.createDataFrame([(None, "c", 1.0), (None, None, None)], "date date, category string, net double")
    assert [land(spark, df, str(tmp_path / "dated"), b) for b in (0, 1)] == [2, 0]
    path = str(tmp_path / "plain")
    mf.record(mf.unseen(df, path), path)
    assert mf.unseen(df, path, batch="1").count() == 0 and mf.unseen(df.withColumn("net", F.lit(2.0)), path, batch="1").count() == 2


def test_the_stream_interrupted_between_entries_and_rows(spark, tmp_path, monkeypatch):
    table = str(tmp_path / "landed")
    df = rows(spark, ["2020-01-01", "2020-02-01"]).select(
        "date", "category", F.lit(0.0).alias("buy"), F.lit(0.0).alias("sell"), "net", F.lit("2024-01-01").cast("timestamp").alias("retrieved_at"))
    new = mf.unseen(df, f"{table}/_hashes", "s", "0", "date")
    mf.record(new, f"{table}/_hashes", "s", "0")  # and no rows
    st.land_batch(df, 0, "other", table, st.LANDED_FLOWS)
    assert st.landed_rows(spark, table).count() == 0
    st.land_batch(df, 0, "s", table, st.LANDED_FLOWS)
    assert sorted(r.date.isoformat() for r in st.landed_rows(spark, table).collect()) == ["2020-01-01", "2020-02-01"]
