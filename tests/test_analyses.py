"""Rules over the result tables of an analysis."""

import datetime as dt

import pytest

from tidemark.operators import quality as ql

A = ("analysis_key string, status string, grade string, n long, start_date date, end_date date, source_start date, source_end date,"
     " eligible boolean, available long, expected string, focal_terms array<string>, diagnostic_keys array<string>")
E = ("analysis_key string, position int, term string, value double, ci_low double, ci_high double, confidence_level double, se double,"
     " p_value double, adjusted_p_value double, is_focal boolean")
D = "analysis_key string, position int, key string, passed boolean"
DAY = dt.date(2000, 1, 1)


def analysis(status, **new):
    row = {"analysis_key": "k", "status": status, "grade": "limited", "n": 40, "start_date": DAY, "end_date": DAY, "source_start": DAY, "source_end": DAY,
           "eligible": True, "available": 40, "expected": "positive", "focal_terms": ["x", "y"], "diagnostic_keys": ["d"]}
    return tuple((row | new).values())


def estimate(position, term, value, adjusted, focal, **new):
    row = {"analysis_key": "k", "position": position, "term": term, "value": value, "ci_low": value - 1, "ci_high": value + 1, "confidence_level": 0.95,
           "se": 0.1, "p_value": adjusted, "adjusted_p_value": adjusted, "is_focal": focal}
    return tuple((row | new).values())


GOOD = [estimate(1, "x", 2.0, 0.01, True), estimate(2, "y", 1.0, 0.02, True)]
# A secondary row that is neither significant nor of the expected sign, without an adjusted p-value.
SECONDARY = estimate(3, "z", -4.0, None, False, p_value=0.9)


def problems(spark, row, estimates, passed=True):
    out = ql.check_analyses(spark.createDataFrame([row], A), spark.createDataFrame(estimates, E), spark.createDataFrame([("k", 1, "d", passed)], D))
    return {r.problem for r in out.collect()}


def test_secondary_rows_of_a_supported_analysis_raise_nothing(spark):
    assert problems(spark, analysis("supported"), [*GOOD, SECONDARY]) == set()


@pytest.mark.parametrize(("row", "estimates", "passed", "wanted"), [
    (analysis("supported"), [GOOD[0], estimate(2, "y", -1.0, 0.02, True)], True, {"supported_contradicts_rule"}),
    (analysis("supported", expected="two_sided"), [GOOD[0], estimate(2, "y", -1.0, 0.02, True)], True, set()),
    (analysis("supported"), GOOD, False, {"supported_contradicts_rule"}),
    (analysis("not_supported"), GOOD, True, {"not_supported_contradicts_rule"}),
    (analysis("failed_diagnostics"), GOOD, True, {"failed_without_diagnostic"}),
    (analysis("mixed"), [SECONDARY], True, {"inference_without_focal", "focal_terms_differ"}),
    (analysis("mixed", diagnostic_keys=["e"]), [GOOD[1], estimate(0, "y", 1.0, 0.2, True)], True, {"diagnostics_differ", "focal_terms_differ"}),
    (analysis("descriptive_only"), GOOD, True, {"descriptive_with_p_value", "descriptive_with_other_grade"}),
    (analysis("descriptive_only", grade="descriptive"), [estimate(1, "x", 2.0, None, True)], True, set()),
    (analysis("insufficient_data", n=3), GOOD[:1], True, {"insufficient_with_estimate", "insufficient_but_eligible", "count_differs"}),
    (analysis("insufficient_data", eligible=False), [], True, set()),
    (analysis("mixed", end_date=None), [estimate(1, "x", 2.0, 0.01, True, confidence_level=None), estimate(2, "y", 1.0, 0.02, True, ci_low=3.0)], True,
     {"sample_dates_half_set", "interval_without_level", "interval_reversed"}),
])
def test_rules(spark, row, estimates, passed, wanted):
    assert problems(spark, row, estimates, passed) == wanted
