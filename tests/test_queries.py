"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from checks import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


def test_registry_is_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 200


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, duck, key):
    names, got = compare.spark_rows(QUERIES[key](spark, SF))
    assert len(set(names)) == len(names)
    if key in ORACLES:
        expected_names, expected = compare.duck_rows(duck, ORACLES[key])
        assert names == expected_names
        assert got == expected


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
