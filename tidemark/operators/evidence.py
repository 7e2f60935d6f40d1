"""Eligibility, multiple testing, diagnostics, grading.

Result tables are long: ``estimates(analysis_key, term, is_focal, ...)``,
``diagnostics(analysis_key, key, value, threshold, passed)`` and
``robustness(analysis_key, specification, status, value, p_value)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scalars import col
from tidemark.operators.regression import INTERCEPT, design_rank, direction_matches
from tidemark.session import settle

ALPHA = 0.05
CHECKS = (
    "minimum_observations", "minimum_complete_pairs", "dependent_variation", "focal_variation",
    "residual_degrees_of_freedom", "no_exact_multicollinearity", "no_future_information",
)
# Thresholds of the registered diagnostics.
CONDITION_LIMIT = 30.0
AUTOCORRELATION_LEVEL = 0.01
STATIONARITY_LEVEL = 0.10
INFLUENCE_LIMIT = 1.0


def bh_adjust(pvals: DataFrame, family=("family",), p: str = "p_value",
              out: str = "adjusted_p_value", buckets: int = 1024) -> DataFrame:
    """Benjamini-Hochberg within a family; a missing p enters as 1.

    Equal p-values share one adjusted value, so tests are counted per distinct
    p first.  Distinct values are split into ``buckets`` ranges of p, and below
    the first of these into ranges of its logarithm, so tests that are all very
    small spread as well: ranks and the running minimum from above are carried
    across ranges by per-range totals, and a family with most of the tests
    spreads over many tasks.  The tests are read several times and are settled
    first.
    """
    family = list(family)
    entered = settle(pvals).withColumn("_p", F.coalesce(col(p), F.lit(1.0)))
    scaled = F.col("_p") * buckets
    bucket = F.when(scaled >= 1.0, F.least(F.floor(scaled), F.lit(buckets - 1))).when(
        scaled > 0.0, F.floor(F.ln(scaled) * 64.0)).otherwise(F.lit(-1_000_000)).cast("int")
    values = entered.groupBy(*family, "_p").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", bucket)

    whole = W.partitionBy(*family)
    before = whole.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ranges = values.groupBy(*family, "_b").agg(F.sum("_c").alias("_c")).select(
        *family, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("_m"),
    )
    inside = W.partitionBy(*family, "_b")
    rank = F.col("_before") + F.sum("_c").over(inside.orderBy("_p"))
    raw = values.join(ranges, [*family, "_b"]).withColumn("_raw", F.col("_p") * F.col("_m") / rank)
    after = whole.orderBy(F.col("_b").desc()).rowsBetween(W.unboundedPreceding, -1)
    later = raw.groupBy(*family, "_b").agg(F.min("_raw").alias("_low")).select(
        *family, "_b", F.min("_low").over(after).alias("_later")
    )
    from_above = inside.orderBy(F.col("_p").desc()).rowsBetween(W.unboundedPreceding, 0)
    adjusted = raw.join(later, [*family, "_b"]).select(
        *family, "_p",
        # LEAST skips the null of the last range.
        F.least(F.min("_raw").over(from_above), F.col("_later"), F.lit(1.0)).alias(out),
    )
    return entered.join(adjusted, [*family, "_p"]).drop("_p")


def variation(value) -> Column:
    """More than one distinct value after rounding to 12 digits."""
    v = F.round(col(value), 12)
    return F.coalesce(F.min(v) != F.max(v), F.lit(False))


def eligibility(sample: DataFrame, *, dependent, focal, controls=(), min_observations: int,
                min_pairs: int, parameters: int, min_residual_df: int, by=()) -> DataFrame:
    """Seven pre-estimation gates of an aligned sample, one row per group."""
    by = tuple(by)
    dependent, focal, controls = list(dependent), list(focal), list(controls)
    n = F.count(F.lit(1))

    def all_vary(names) -> Column:
        return reduce(lambda a, b: a & b, [variation(c) for c in names], F.lit(True)) & (n > 0)

    source_dates = [c for c in sample.columns if c.endswith("__source_date")]
    peeks = reduce(
        lambda a, b: a | b, [F.col(c) > F.col("date") for c in source_dates], F.lit(False)
    )
    dependent_ok = all_vary(dependent)
    gates = sample.groupBy(*by).agg(
        n.alias("n"), F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        (n >= min_observations).alias("minimum_observations"),
        (n >= min_pairs).alias("minimum_complete_pairs"),
        dependent_ok.alias("dependent_variation"),
        (all_vary(focal) if focal else dependent_ok).alias("focal_variation"),
        (n - parameters >= min_residual_df).alias("residual_degrees_of_freedom"),
        (F.count_if(peeks) == 0).alias("no_future_information"),
    )
    explanatory = focal + controls
    if explanatory:
        ranks = design_rank(sample, (INTERCEPT, *explanatory), by).select(
            *by, F.col("full_rank").alias("no_exact_multicollinearity")
        )
        if by:
            gates = gates.join(ranks, list(by), "left")
        else:
            gates = gates.withColumn("no_exact_multicollinearity", ranks.select("no_exact_multicollinearity").scalar())
        empty = F.col("n") == 0
        gates = gates.withColumn(
            "no_exact_multicollinearity",
            F.coalesce(F.col("no_exact_multicollinearity"), F.lit(False)) | empty,
        )
    else:
        gates = gates.withColumn("no_exact_multicollinearity", F.lit(True))
    failed = F.array_compact(F.array(*[F.when(~F.col(c), F.lit(c)) for c in CHECKS]))
    required = max(min_observations, min_pairs, parameters + min_residual_df)
    reason = F.when(
        F.size("_failed") == 0, F.lit("All registered pre-estimation eligibility gates passed.")
    ).otherwise(F.concat(
        F.lit("Failed registered eligibility gates: "), F.array_join("_failed", ", "), F.lit(".")
    ))
    return gates.withColumn("_failed", failed).select(
        *by, "n", "start_date", "end_date", *CHECKS,
        (F.size("_failed") == 0).alias("eligible"),
        F.lit(required).alias("required_observations"), reason.alias("reason"),
    )


def insufficient(eligibility_rows: DataFrame) -> DataFrame:
    """Publishable result rows for the samples that failed a gate."""
    return eligibility_rows.where(~F.col("eligible")).withColumns({
        "status": F.lit("insufficient_data"), "grade": F.lit("not_assessed"),
    })


def readiness(tables: dict[str, DataFrame]) -> DataFrame:
    """Eligibility rows of several analyses in one table."""
    parts = [t.withColumn("analysis_key", F.lit(k)) for k, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def diagnostic_flags(values: DataFrame, min_residual_df: int, keys=("analysis_key",)) -> DataFrame:
    """Pass or fail per diagnostic from one wide row of values per analysis.

    Columns used when present: df, condition, bg_p_value, adf_p_value,
    max_cooks, stable.
    """
    number = {
        "residual_degrees_of_freedom": ("df", float(min_residual_df), lambda v, t: v >= t),
        "condition_number": ("condition", CONDITION_LIMIT, lambda v, t: v <= t),
        "residual_autocorrelation": ("bg_p_value", AUTOCORRELATION_LEVEL, lambda v, t: v >= t),
        "stationarity": ("adf_p_value", STATIONARITY_LEVEL, lambda v, t: v < t),
        "influential_observation": ("max_cooks", INFLUENCE_LIMIT, lambda v, t: v <= t),
    }
    entries = []
    for key, (name, threshold, rule) in number.items():
        if name in values.columns:
            v = F.col(name).cast("double")
            entries.append(F.struct(
                F.lit(key).alias("key"), v.alias("value"), F.lit(threshold).alias("threshold"),
                F.coalesce(rule(v, F.lit(threshold)), F.lit(False)).alias("passed"),
            ))
    if "stable" in values.columns:
        entries.append(F.struct(
            F.lit("stability").alias("key"), F.col("stable").cast("double").alias("value"),
            F.lit(None).cast("double").alias("threshold"),
            F.coalesce(F.col("stable"), F.lit(False)).alias("passed"),
        ))
    return values.select(*keys, F.inline(F.array(*entries)))


def robustness_status(p_value, value, expected, alpha: float = ALPHA) -> Column:
    """Supported when significant in the expected direction; null p: no fit."""
    p, v = col(p_value), col(value)
    if isinstance(expected, str):
        right_way = direction_matches(v, expected)
    else:
        right_way = (
            F.when(expected == "positive", v > 0).when(expected == "negative", v < 0).otherwise(v != 0)
        )
    return F.when(v.isNull(), F.lit("insufficient_data")).when(
        (p < alpha) & right_way, F.lit("supported")
    ).otherwise(F.lit("not_supported"))


def grade(focal: DataFrame, diagnostics: DataFrame, robustness: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Status and grade per analysis from the three result tables.

    ``focal(analysis_key, value, adjusted_p_value, expected)``.  An analysis is
    supported when every focal estimate is significant in its direction, no
    diagnostic failed, every robustness fit could be made and points the same
    way, and at least half of them are supported on their own.
    """
    v, e = F.col("value"), F.col("expected")
    ways = {"positive": v > 0, "negative": v < 0, "either": v != 0}

    def by_direction(of: dict[str, Column]) -> Column:
        return F.when(e == "positive", of["positive"]).when(e == "negative", of["negative"]).otherwise(of["either"])

    main = focal.groupBy("analysis_key").agg(
        F.min(F.coalesce((F.col("adjusted_p_value") < alpha) & by_direction(ways), F.lit(False))).alias("main_support"),
        F.first("expected").alias("expected"),
    )
    failed = diagnostics.groupBy("analysis_key").agg(F.max(~F.col("passed")).alias("failed"))
    # Fits are counted for every direction before they meet the analyses, so none is sorted.
    robust = robustness.groupBy("analysis_key").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(v.isNotNull() & (F.col("status") == "supported")).alias("supported_checks"),
        *[F.min(F.coalesce(way, F.lit(False))).alias(f"_{name}") for name, way in ways.items()],
    )
    joined = main.join(failed, "analysis_key", "left").join(robust, "analysis_key", "left").select(
        "analysis_key", "main_support",
        F.coalesce("failed", F.lit(False)).alias("failed"),
        F.coalesce("checks", F.lit(0)).alias("checks"),
        F.coalesce("supported_checks", F.lit(0)).alias("supported_checks"),
        F.coalesce(by_direction({name: F.col(f"_{name}") for name in ways}), F.lit(True)).alias("consistent"),
    )
    half = F.col("supported_checks") >= F.ceil(F.col("checks") / 2)
    status = (
        F.when(F.col("failed"), F.lit("failed_diagnostics"))
        .when(F.col("main_support"), F.when(F.col("consistent") & half, F.lit("supported")).otherwise("mixed"))
        .when(F.col("supported_checks") > 0, F.lit("mixed"))
        .otherwise("not_supported")
    )
    rank = (
        F.when((F.col("status") == "supported") & (F.col("supported_checks") == F.col("checks")), F.lit("strong"))
        .when(F.col("status") == "supported", F.lit("moderate"))
        .otherwise("limited")
    )
    return joined.withColumn("status", status).withColumn("grade", rank).select(
        "analysis_key", "main_support", "failed", "checks", "supported_checks", "status", "grade"
    )


def review(published: DataFrame, recomputed: DataFrame, keys, tolerance: float = 1e-9,
           value: str = "value") -> DataFrame:
    """Rows whose published value is absent or off by more than the tolerance."""
    keys = list(keys)
    joined = published.select(*keys, col(value).alias("published")).join(
        recomputed.select(*keys, col(value).alias("recomputed")), keys, "full_outer"
    )
    one_missing = F.col("published").isNull() != F.col("recomputed").isNull()
    scale = F.greatest(F.lit(1.0), F.abs("published"), F.abs("recomputed"))
    drift = F.abs(F.col("published") - F.col("recomputed")) > F.lit(tolerance) * scale
    return joined.where(one_missing | F.coalesce(drift, F.lit(False)))


# What a published diagnostic has to meet, by its own value and threshold.
FLAG_RULES = {
    "residual_degrees_of_freedom": "value >= threshold", "condition_number": "value <= threshold",
    "residual_autocorrelation": "value >= threshold", "stationarity": "value < threshold",
    "influential_observation": "value <= threshold", "stability": "value = 1",
}


def _points(expected: str = "expected", value: str = "value") -> Column:
    """Does a value point the expected way?  A null does not."""
    signs = F.when(F.col(expected) == "positive", F.lit(1)).when(F.col(expected) == "negative", F.lit(-1))
    way = F.signum(value)
    return F.coalesce(F.when(signs.isNull(), way != 0).otherwise(way == signs), F.lit(False))


def review_decisions(analyses: DataFrame, estimates: DataFrame, diagnostics: DataFrame, robustness: DataFrame,
                     alpha: float = ALPHA, robust_alpha: float = ALPHA, tolerance: float = 1e-9) -> DataFrame:
    """Published decisions that the published rows do not give: ``analysis_key, item, subject, published, derived``.

    ``analyses(analysis_key, family, expected, status, grade)``,
    ``estimates(analysis_key, term, value, p_value, adjusted_p_value, is_focal)``,
    ``diagnostics(analysis_key, key, value, threshold, passed)`` and
    ``robustness(analysis_key, specification, value, p_value, status)``.

    A second way beside ``grade``: every flag, robustness status and adjusted
    p-value is derived again from its own numbers, evidence becomes points per
    analysis in one aggregate, and status and grade follow from the counts.  An
    analysis without focal estimates has insufficient data; a descriptive one
    is not reviewed.  Diagnostics without a known rule keep their flag.

    What several passes read (analyses, adjusted p-values, refits) is settled,
    so that no task sorts for more than one of them; diagnostics are filtered
    or counted before they meet the analyses.
    """
    names = ("analysis_key", "item", "subject", "published", "derived")
    reviewed = settle(analyses.where("status is null or status <> 'descriptive_only'").select(
        "analysis_key", "family", "expected", "status", "grade"))
    expected = reviewed.select("analysis_key", "expected")

    # Other columns of the tables may share names.
    estimates = estimates.where("is_focal").select("analysis_key", "term", "value", "p_value", "adjusted_p_value")
    diagnostics = diagnostics.select("analysis_key", "key", "value", "threshold", "passed")
    robustness = robustness.select("analysis_key", "specification", "value", "p_value", "status")
    focal = estimates.join(expected, "analysis_key")
    entered = reviewed.select("analysis_key", "family").join(
        focal.select("analysis_key", "term", "p_value", F.col("adjusted_p_value").alias("_published")), "analysis_key", "left")
    adjusted = settle(bh_adjust(entered, out="_derived").where("term is not null"))
    off = ~F.coalesce(F.abs(F.col("_published") - F.col("_derived")) <= tolerance, F.lit(False))
    drifts = [adjusted.where(off).select(
        "analysis_key", F.lit("adjusted_p_value").alias("item"), F.col("term").alias("subject"),
        F.col("_published").cast("string").alias("published"), F.col("_derived").cast("string").alias("derived"))]

    rule = F.col("passed")
    for key, condition in FLAG_RULES.items():
        rule = F.when(F.col("key") == key, F.coalesce(F.expr(condition), F.lit(False))).otherwise(rule)
    flags = diagnostics.withColumn("_passed", rule)
    drifts.append(flags.where("not (passed <=> _passed)").join(expected, "analysis_key").select(
        "analysis_key", F.lit("diagnostic").alias("item"), F.col("key").alias("subject"),
        F.col("passed").cast("string").alias("published"), F.col("_passed").cast("string").alias("derived")))

    significant = F.coalesce(F.col("p_value") < robust_alpha, F.lit(False))
    refits = settle(robustness.join(expected, "analysis_key").withColumn("_points", _points()).select(
        "analysis_key", F.col("specification").cast("string").alias("subject"), "status", "_points",
        F.when(F.col("value").isNull(), "insufficient_data").when(significant & F.col("_points"), "supported")
        .otherwise("not_supported").alias("_status")))
    drifts.append(refits.where("not (status <=> _status)").select(
        "analysis_key", F.lit("robustness").alias("item"), "subject",
        F.col("status").alias("published"), F.col("_status").alias("derived")))

    # Evidence as points: focal estimates and those that hold, failures, refits, those that point and support.
    derived_p = adjusted.select("analysis_key", "term", "_derived")
    held = focal.join(derived_p, ["analysis_key", "term"]).select(
        "analysis_key", F.lit(1).alias("main"), ((F.col("_derived") < alpha) & _points()).cast("int").alias("holds"))
    failed = flags.groupBy("analysis_key").agg(F.count_if(~F.coalesce("_passed", F.lit(True))).alias("failed")).join(
        reviewed.select("analysis_key"), "analysis_key")
    tried = refits.select("analysis_key", F.lit(1).alias("refits"), F.col("_points").cast("int").alias("points"),
                          (F.col("_status") == "supported").cast("int").alias("supports"))
    evidence = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [reviewed.select("analysis_key"), held, failed, tried])
    tally = evidence.groupBy("analysis_key").agg(*[
        F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("main", "holds", "failed", "refits", "points", "supports")])
    whole = F.expr("points = refits and 2 * supports >= refits")
    status = F.expr("case when main = 0 then 'insufficient_data' when failed > 0 then 'failed_diagnostics' end")
    status = F.coalesce(status, F.when(F.expr("holds = main") & whole, "supported").when(
        F.expr("holds = main or supports > 0"), "mixed").otherwise("not_supported"))
    grades = F.expr("case when _status = 'insufficient_data' then 'not_assessed' when _status <> 'supported' then 'limited'"
                    " when supports = refits then 'strong' else 'moderate' end")
    decided = reviewed.join(tally.withColumn("_status", status).withColumn("_grade", grades), "analysis_key")
    drifts.append(decided.select("analysis_key", F.inline(F.array(*[F.struct(
        F.lit(item).alias("item"), F.lit(None).cast("string").alias("subject"), F.col(item).alias("published"),
        F.col(f"_{item}").alias("derived")) for item in ("status", "grade")]))).where("not (published <=> derived)"))
    return reduce(lambda a, b: a.unionByName(b), drifts).select(*names)
