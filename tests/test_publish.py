"""Publication: all outputs or none."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality as ql
from tidemark.sources import publish as pb

CHECKS = {
    "keys repeat": lambda s: ql.check_unique(s["a"], ["k"]),
    "values are not finite": lambda s: ql.check_finite(s["b"]),
    "a key of b is not in a": lambda s: s["b"].join(s["a"], "k", "left_anti"),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, value double")


@pytest.fixture
def root(spark, tmp_path):
    root = str(tmp_path / "out")
    good = {"a": frame(spark, [("x", 1.0), ("y", 2.0)]), "b": frame(spark, [("x", 3.0)])}
    assert pb.publish(good, CHECKS, root) == 0
    return root


def state(spark, root):
    return {n: sorted(map(tuple, pb.published(spark, root, n).collect())) for n in ("a", "b")}, pb._versions(spark, root)


def test_a_failing_output_leaves_everything_as_it_was(spark, root):
    before = state(spark, root)
    bad = {"a": frame(spark, [("x", 5.0), ("x", 6.0)]), "b": frame(spark, [("z", float("nan")), ("x", 1.0)])}
    with pytest.raises(ql.DataQualityError) as error:
        pb.publish(bad, CHECKS, root)
    assert all(m in str(error.value) for m in CHECKS), "every broken check is named"
    assert state(spark, root) == before
    assert pb.retire(spark, root) == 0, "nothing of the failed run is left"


def test_one_output_is_checked_with_the_others_as_published(spark, root):
    with pytest.raises(ql.DataQualityError, match="not in a"):
        pb.publish({"b": frame(spark, [("w", 1.0)])}, CHECKS, root)
    assert pb.publish({"b": frame(spark, [("y", 1.0)])}, CHECKS, root) == 1
    assert state(spark, root) == ({"a": [("x", 1.0), ("y", 2.0)], "b": [("y", 1.0)]}, [0, 1])
    assert sorted(map(tuple, pb.published(spark, root, "b", 0).collect())) == [("x", 3.0)]


def test_an_interrupted_run_is_not_seen(spark, root, monkeypatch):
    before = state(spark, root)
    monkeypatch.setattr(pb, "content_hash", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        pb.publish({"a": frame(spark, [("x", 9.0)])}, {}, root)
    monkeypatch.undo()
    assert state(spark, root) == before
    assert pb.retire(spark, root) == 1 and state(spark, root) == before


def test_the_second_of_two_writers_fails(spark, root, monkeypatch):
    monkeypatch.setattr(pb, "_versions", lambda *a: [])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        pb.publish({"a": frame(spark, [("x", 9.0)])}, {}, root)
    monkeypatch.undo()
    assert state(spark, root)[0]["a"] == [("x", 1.0), ("y", 2.0)]


def test_changed_files_are_noticed(spark, root):
    assert all(r.same for r in pb.verify_published(spark, root).collect())
    path = next(r.path for r in pb.published_set(spark, root).collect() if r.name == "a")
    frame(spark, [("x", 1.5)]).write.mode("append").parquet(f"{root}/{path}")
    assert {r.name: r.same for r in pb.verify_published(spark, root).collect()} == {"a": False, "b": True}


def test_nothing_published(spark, tmp_path):
    root = str(tmp_path / "none")
    assert pb.verify_published(spark, root).count() == 0 and pb.retire(spark, root) == 0
    with pytest.raises(KeyError):
        pb.published(spark, root, "a")
    empty = spark.createDataFrame([], "k string, value double")
    assert pb.publish({"a": empty}, {}, root) == 0 and pb.published(spark, root, "a").count() == 0
    assert all(r.same for r in pb.verify_published(spark, root).withColumn("same", F.coalesce("same", F.lit(False))).collect())
