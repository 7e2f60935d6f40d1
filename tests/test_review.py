"""Decisions derived again from published rows."""

import pytest

from tidemark.operators import evidence as ev

A = "analysis_key string, family string, expected string, status string, grade string"
E = "analysis_key string, term string, value double, p_value double, adjusted_p_value double, is_focal boolean"
D = "analysis_key string, key string, value double, threshold double, passed boolean"
R = "analysis_key string, specification string, value double, p_value double, status string"

ANALYSES = [("s", "f", "positive", "supported", "strong"), ("m", "f", "negative", "mixed", "limited"),
            ("d", "g", "positive", "failed_diagnostics", "limited"), ("i", "f", "positive", "insufficient_data", "not_assessed"),
            ("n", "g", "two_sided", "not_supported", "limited"), ("t", "g", "positive", "descriptive_only", "descriptive")]
# Family f has three members, one without an estimate; family g has two.
ESTIMATES = [("s", "x", 2.0, 0.001, 0.003, True), ("s", "z", -9.0, 0.9, None, False), ("m", "x", -1.0, 0.02, 0.03, True),
             ("d", "x", 1.0, 0.01, 0.02, True), ("n", "x", 1.0, 0.4, 0.4, True)]
DIAGNOSTICS = [("s", "condition_number", 3.0, 30.0, True), ("s", "stability", 1.0, None, True), ("d", "stationarity", 0.2, 0.1, False),
               ("m", "residual_autocorrelation", 0.5, 0.01, True)]
ROBUSTNESS = [("s", "a", 1.0, 0.01, "supported"), ("s", "b", 1.5, 0.04, "supported"), ("m", "a", None, None, "insufficient_data"),
              ("m", "b", -1.0, 0.01, "supported"), ("n", "a", 1.0, 0.3, "not_supported")]


def drifts(spark, analyses=ANALYSES, estimates=ESTIMATES, diagnostics=DIAGNOSTICS, robustness=ROBUSTNESS):
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((analyses, A), (estimates, E), (diagnostics, D), (robustness, R))]
    return {(r.analysis_key, r.item, r.subject): (r.published, r.derived) for r in ev.review_decisions(*tables).collect()}


def replaced(rows, at, **new):
    out = list(rows)
    row = list(out[at])
    for position, value in new.items():
        row[int(position[1:])] = value
    out[at] = tuple(row)
    return out


def test_right_decisions_raise_nothing(spark):
    assert drifts(spark) == {}


@pytest.mark.parametrize(("tables", "wanted"), [
    ({"analyses": replaced(ANALYSES, 0, _4="moderate")}, {("s", "grade", None): ("moderate", "strong")}),
    ({"analyses": replaced(ANALYSES, 1, _3="supported", _4="moderate")},
     {("m", "status", None): ("supported", "mixed"), ("m", "grade", None): ("moderate", "limited")}),
    ({"robustness": replaced(ROBUSTNESS, 1, _4="not_supported")}, {("s", "robustness", "b"): ("not_supported", "supported")}),
    ({"diagnostics": replaced(DIAGNOSTICS, 2, _4=True)}, {("d", "diagnostic", "stationarity"): ("true", "false")}),
    ({"estimates": replaced(ESTIMATES, 2, _4=0.02)}, {("m", "adjusted_p_value", "x"): ("0.02", "0.03")}),
    ({"analyses": replaced(ANALYSES, 3, _3="not_supported", _4="limited")},
     {("i", "status", None): ("not_supported", "insufficient_data"), ("i", "grade", None): ("limited", "not_assessed")}),
])
def test_what_differs_is_reported(spark, tables, wanted):
    assert drifts(spark, **tables) == wanted


def test_empty_tables(spark):
    assert drifts(spark, [], [], [], []) == {}


def test_analyses_and_refits_are_read_once(spark, tmp_path):
    """The result reads what was settled: no task sorts for several passes; a repeated analysis still counts twice."""
    tables = []
    for name, rows, schema in (("analyses", [*ANALYSES, ("d", "g", "positive", "supported", "limited")], A), ("estimates", ESTIMATES, E),
                               ("diagnostics", replaced(DIAGNOSTICS, 2, _4=True), D), ("robustness", ROBUSTNESS, R)):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    out = ev.review_decisions(*tables)
    assert not any(f"/{name}/" in file for file in out.inputFiles() for name in ("analyses", "robustness"))
    got = sorted((r.analysis_key, r.item, r.published, r.derived) for r in out.collect())
    assert [g for g in got if g[1] == "diagnostic"] == [("d", "diagnostic", "true", "false")] * 2
    assert ("d", "status", "supported", "failed_diagnostics") in got


def test_grade_points_by_direction(spark):
    """Refits are counted before the direction is known; nulls and refits of no analysis as before."""
    focal = spark.createDataFrame([("p", 1.0, 0.01, "positive"), ("n", -1.0, 0.01, "negative"), ("e", -1.0, 0.01, "two_sided"), ("z", 1.0, 0.01, "positive"),
                                   ("u", 1.0, 0.01, None)], "analysis_key string, value double, adjusted_p_value double, expected string")
    refits = [("p", "a", 1.0, 0.01, "supported"), ("n", "a", -1.0, 0.01, "supported"), ("n", "b", 1.0, 0.01, "supported"),
              ("e", "a", 1.0, 0.01, "supported"), ("e", "b", -1.0, 0.4, "not_supported"), ("z", "a", None, None, "supported"),
              ("u", "a", -1.0, 0.01, "supported"), ("x", "a", 1.0, 0.01, "supported"), (None, "a", 1.0, 0.01, "supported")]
    robust = spark.createDataFrame(refits, R)
    got = {r.analysis_key: (r.checks, r.supported_checks, r.grade) for r in ev.grade(focal, spark.createDataFrame([], D), robust).collect()}
    assert got == {"p": (1, 1, "strong"), "n": (2, 2, "limited"), "e": (2, 1, "moderate"), "z": (1, 0, "limited"), "u": (1, 1, "strong")}
    plan = ev.grade(focal, spark.createDataFrame([], D), robust)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # refits are not joined row by row
