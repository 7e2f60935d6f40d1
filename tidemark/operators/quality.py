"""Data-quality rules (V1-V16).  Each returns the violating rows.

``require_clean`` turns a rule into a gate: it looks at a handful of rows and
raises, so nothing but an error message travels to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scalars import col
from tidemark.operators.evidence import ALPHA

INFERENTIAL = ("supported", "not_supported", "mixed", "failed_diagnostics")
# Wording that a non-causal interpretation must not use; fixed patterns.
CAUSAL_PATTERNS = (
    r"\bcauses?\b",
    r"\bcaused\b",
    r"\bcausal effect\b",
    r"\bleads? to\b",
    r"\bresults? in\b",
    r"\bdrives?\b",
)


class DataQualityError(ValueError):
    """Data that fails a publication gate."""


def require_clean(violations: DataFrame, message: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise DataQualityError(f"{message}: {[r.asDict() for r in rows]}")


def check_unique(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_min_rows(df: DataFrame, minimum: int = 2) -> DataFrame:
    """One row when the frame is too short."""
    return df.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") < minimum).withColumn(
        "minimum", F.lit(minimum)
    )


def check_domain(df: DataFrame, column: str, allowed) -> DataFrame:
    """Rows per value outside the allowed set; null is outside."""
    inside = F.coalesce(col(column).isin(list(allowed)), F.lit(False))
    return df.where(~inside).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def check_required(df: DataFrame, required: DataFrame, key: str = "indicator", value: str = "value") -> DataFrame:
    """Required keys without any non-null value."""
    present = df.where(col(value).isNotNull()).select(key).distinct()
    return required.select(key).distinct().join(present, key, "left_anti")


def check_bounds(df: DataFrame, bounds: DataFrame, key: str = "indicator", value: str = "value") -> DataFrame:
    """Values below the lower or above the upper bound of their series."""
    joined = df.join(bounds.select(key, "lower", "upper"), key)
    low, high = col(value) < F.col("lower"), col(value) > F.col("upper")
    return joined.where(F.coalesce(low, F.lit(False)) | F.coalesce(high, F.lit(False)))


def check_finite(df: DataFrame, value: str = "value") -> DataFrame:
    return df.where(F.isnan(col(value)) | (F.abs(col(value)) == float("inf")))


def check_coverage(df: DataFrame, stated: DataFrame, key: str, date: str = "date") -> DataFrame:
    """Keys whose stated date range differs from the observed one."""
    seen = df.groupBy(key).agg(F.min(date).alias("seen_start"), F.max(date).alias("seen_end"))
    joined = stated.join(seen, key, "full_outer")
    same = F.col("start_date").eqNullSafe(F.col("seen_start")) & F.col("end_date").eqNullSafe(F.col("seen_end"))
    return joined.where(~same)


def check_ordered(df: DataFrame, keys, position: str, date: str = "date",
                  chunk: int = 1_000_000) -> DataFrame:
    """Rows whose date is not after that of the previous position.

    Positions are numbers.  Each key is cut into ranges of ``chunk`` positions;
    the first row of a range is compared with the last row of the range before,
    so a key with most of the rows is checked in parallel.
    """
    keys = list(keys)
    cut = df.withColumn("_chunk", F.floor(col(position) / F.lit(chunk)))
    ends = cut.groupBy(*keys, "_chunk").agg(F.max_by(col(date), col(position)).alias("_last"))
    carried = ends.select(
        *keys, "_chunk", F.lag("_last").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_before")
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(position)
    first = F.row_number().over(inside) == 1
    return (
        cut.join(carried, [*keys, "_chunk"])
        .withColumn("previous", F.when(first, F.col("_before")).otherwise(F.lag(date).over(inside)))
        .where(col(date) <= F.col("previous"))
        .drop("_chunk", "_before")
    )


def check_no_lookahead(df: DataFrame, source_dates, date: str = "date") -> DataFrame:
    late = reduce(lambda a, b: a | b, [col(s) > col(date) for s in source_dates])
    return df.where(late)


def check_correlation(df: DataFrame, column: str = "corr") -> DataFrame:
    return df.where(~col(column).between(-1.0, 1.0))


def check_registry(df: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Unknown and missing keys against a registry."""
    have, want = df.select(key).distinct(), registry.select(key).distinct()
    return have.join(want, key, "left_anti").withColumn("problem", F.lit("unknown")).unionByName(
        want.join(have, key, "left_anti").withColumn("problem", F.lit("missing"))
    )


def check_reconcile(flows: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Flow rows whose net is not buy minus sell."""
    return flows.where(F.abs(F.col("buy") - F.col("sell") - F.col("net")) > tolerance)


def check_categories(flows: DataFrame, required, by: str = "date") -> DataFrame:
    """Dates on which a required category is absent."""
    required = list(required)
    return flows.groupBy(by).agg(
        F.count_distinct(F.when(F.col("category").isin(required), F.col("category"))).alias("n")
    ).where(F.col("n") < len(required))


def check_part_whole(df: DataFrame, part: str, whole: str) -> DataFrame:
    """Rows whose part exceeds the whole, or with a non-positive figure."""
    return df.where((col(part) > col(whole)) | (col(part) <= 0) | (col(whole) <= 0))


def check_windows(events: DataFrame) -> DataFrame:
    """Reversed windows and repeated event ids."""
    reversed_ = events.where("start_date > end_date").select("event_id", F.lit("reversed").alias("problem"))
    repeated = check_unique(events, ["event_id"]).select("event_id", F.lit("duplicate").alias("problem"))
    return reversed_.unionByName(repeated)


def check_text(df: DataFrame, column: str, patterns=CAUSAL_PATTERNS) -> DataFrame:
    """Rows whose lower-cased text matches a pattern, with the first such one.

    One alternation decides which rows match; the patterns are then tried one by
    one on those rows only.
    """
    patterns = list(patterns)
    text = F.lower(col(column))
    hit: Column = F.lit(patterns[-1])
    for p in reversed(patterns[:-1]):
        hit = F.when(text.rlike(p), F.lit(p)).otherwise(hit)
    return df.where(text.rlike("|".join(f"(?:{p})" for p in patterns))).withColumn("pattern", hit)


def check_evidence(results: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Incoherent result rows and every rule they break.

    Columns: analysis_key, status, n, start_date, end_date, source_start,
    source_end, eligible, available, value, ci_low, ci_high, se, p_value,
    adjusted_p_value, is_focal, expected, failed.
    """
    inferential = F.col("status").isin(*INFERENTIAL)
    estimate = F.col("value").isNotNull()
    right_way = (
        F.when(F.col("expected") == "positive", F.col("value") > 0)
        .when(F.col("expected") == "negative", F.col("value") < 0).otherwise(F.col("value") != 0)
    )
    supported = F.coalesce((F.col("adjusted_p_value") < alpha) & right_way, F.lit(False))
    rules = {
        "interval_reversed": F.col("ci_low") > F.col("ci_high"),
        "estimate_outside_interval": ~F.col("value").between(F.col("ci_low"), F.col("ci_high")),
        "adjusted_p_missing": F.col("is_focal") & F.col("p_value").isNotNull() & F.col("adjusted_p_value").isNull(),
        "sample_dates_half_set": F.col("start_date").isNull() != F.col("end_date").isNull(),
        "sample_reversed": F.col("start_date") > F.col("end_date"),
        "sample_outside_sources": (F.col("start_date") < F.col("source_start")) | (F.col("end_date") > F.col("source_end")),
        "inference_without_eligibility": inferential & ~F.coalesce("eligible", F.lit(False)),
        "inference_incomplete": inferential & F.col("is_focal") & (
            F.col("value").isNull() | F.col("se").isNull() | F.col("ci_low").isNull() | F.col("p_value").isNull()
        ),
        "supported_contradicts_rule": (F.col("status") == "supported") & F.col("is_focal") & (~supported | F.col("failed")),
        "not_supported_contradicts_rule": (F.col("status") == "not_supported") & F.col("is_focal") & (supported | F.col("failed")),
        "failed_without_diagnostic": (F.col("status") == "failed_diagnostics") & ~F.col("failed"),
        "insufficient_with_estimate": (F.col("status") == "insufficient_data") & estimate,
        "insufficient_but_eligible": (F.col("status") == "insufficient_data") & F.coalesce("eligible", F.lit(True)),
        "count_differs": F.col("n") != F.col("available"),
    }
    broken = F.array_compact(F.array(*[
        F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()
    ]))
    return results.select("*", F.explode(broken).alias("problem"))


def check_analyses(analyses: DataFrame, estimates: DataFrame, diagnostics: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``analysis_key, problem``: rules over the result tables of each analysis taken together.

    ``analyses(analysis_key, status, grade, n, start_date, end_date,
    source_start, source_end, eligible, available, expected, focal_terms,
    diagnostic_keys)`` has a row for each analysis and the registered order of
    its focal terms and diagnostics (null: any).  ``estimates(analysis_key,
    position, term, value, ci_low, ci_high, confidence_level, se, p_value,
    adjusted_p_value, is_focal)`` and ``diagnostics(analysis_key, position,
    key, passed)`` have its rows.  Support is decided by all focal rows of an
    analysis; other rows can't contradict a status.
    """
    def any_of(test: Column) -> Column:
        return F.coalesce(F.bool_or(F.coalesce(test, F.lit(False))), F.lit(False))

    focal, interval = F.col("is_focal"), F.col("ci_low").isNotNull()
    small = F.coalesce(F.col("adjusted_p_value") < alpha, F.lit(False))

    def every_focal(test: Column) -> Column:
        return F.coalesce(F.bool_and(F.when(focal, F.coalesce(test, F.lit(False)))), F.lit(False))

    facts = estimates.groupBy("analysis_key").agg(
        F.count(F.lit(1)).alias("_estimates"), F.count_if(focal).alias("_focal"),
        any_of(F.col("ci_low") > F.col("ci_high")).alias("_reversed"),
        any_of((F.col("ci_low") <= F.col("ci_high")) & ~F.col("value").between(F.col("ci_low"), F.col("ci_high"))).alias("_outside"),
        any_of(interval & F.col("confidence_level").isNull()).alias("_no_level"),
        any_of(~interval & F.col("confidence_level").isNotNull()).alias("_no_interval"),
        any_of(focal & F.col("p_value").isNotNull() & F.col("adjusted_p_value").isNull()).alias("_unadjusted"),
        any_of(F.col("p_value").isNotNull() | F.col("adjusted_p_value").isNotNull()).alias("_tested"),
        any_of(focal & (F.col("se").isNull() | ~interval | F.col("p_value").isNull() | F.col("adjusted_p_value").isNull())).alias("_incomplete"),
        every_focal(small).alias("_two_sided"), every_focal(small & (F.col("value") > 0)).alias("_positive"),
        every_focal(small & (F.col("value") < 0)).alias("_negative"),
        F.transform(F.sort_array(F.collect_list(F.when(focal, F.struct("position", "term")))), lambda x: x["term"]).alias("_terms"),
    )
    checked = diagnostics.groupBy("analysis_key").agg(
        any_of(~F.col("passed")).alias("_failed"),
        F.transform(F.sort_array(F.collect_list(F.struct("position", "key"))), lambda x: x["key"]).alias("_keys"),
    )
    known = analyses.join(facts, "analysis_key", "left").join(checked, "analysis_key", "left")

    def fact(name: str, otherwise=False) -> Column:
        return F.coalesce(F.col(name), F.lit(otherwise))

    status, eligible = F.col("status"), F.coalesce("eligible", F.lit(False))
    inferential, failed, nothing = status.isin(*INFERENTIAL), fact("_failed"), F.array().cast("array<string>")
    support = F.when(F.col("expected") == "positive", fact("_positive")).when(F.col("expected") == "negative", fact("_negative")).otherwise(fact("_two_sided"))
    rules = {
        "sample_dates_half_set": F.col("start_date").isNull() != F.col("end_date").isNull(),
        "sample_reversed": F.col("start_date") > F.col("end_date"),
        "sample_outside_sources": (F.col("start_date") < F.col("source_start")) | (F.col("end_date") > F.col("source_end")),
        "sources_without_overlap": F.col("source_start") > F.col("source_end"),
        "interval_reversed": fact("_reversed"),
        "estimate_outside_interval": fact("_outside"),
        "interval_without_level": fact("_no_level"),
        "level_without_interval": fact("_no_interval"),
        "adjusted_p_missing": fact("_unadjusted"),
        "inference_without_eligibility": inferential & ~eligible,
        "inference_without_focal": inferential & (fact("_focal", 0) == 0),
        "inference_incomplete": inferential & fact("_incomplete"),
        "focal_terms_differ": inferential & (F.coalesce("_terms", nothing) != F.col("focal_terms")),
        "diagnostics_differ": inferential & (F.coalesce("_keys", nothing) != F.col("diagnostic_keys")),
        "supported_contradicts_rule": (status == "supported") & (~support | failed),
        "not_supported_contradicts_rule": (status == "not_supported") & (support | failed),
        "failed_without_diagnostic": (status == "failed_diagnostics") & ~failed,
        "descriptive_with_p_value": (status == "descriptive_only") & fact("_tested"),
        "descriptive_with_other_grade": (status == "descriptive_only") & ~F.coalesce(F.col("grade") == "descriptive", F.lit(False)),
        "insufficient_with_estimate": (status == "insufficient_data") & (fact("_estimates", 0) > 0),
        "insufficient_but_eligible": (status == "insufficient_data") & F.coalesce("eligible", F.lit(True)),
        "count_differs": F.col("n") != F.col("available"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]))
    return known.select("analysis_key", F.explode(broken).alias("problem"))
