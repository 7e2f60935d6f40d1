"""Status-aware preparation and joining of registered inputs.

Inputs are long frames (input, date, value, status), optionally with group keys
``by`` (an entity, a segment): then every group has its own periods, lags and
exclusion counts, and windows and joins are dealt by the group.  Exclusions are
counted in the same pass that keeps the other rows, so kept + excluded = input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalars import col
from tidemark.operators.growth import at_period
from tidemark.operators.summaries import exclusion_summary, to_quarter

TRANSFORMS = ("level", "difference", "log", "log_difference")
QUARTERLY = {"monthly_to_quarterly_mean": "mean", "monthly_to_quarterly_end": "last",
             "monthly_to_quarterly_sum": "sum"}


@dataclass(frozen=True)
class InputSpec:
    """One registered input of an analysis."""

    name: str
    frequency: str
    role: str = "focal"
    statuses: tuple[str, ...] = ("actual", "revised")
    transform: str = "level"
    lag: int = 0


@dataclass(frozen=True)
class Aligned:
    """Aligned sample (wide) and its exclusion counts (long)."""

    sample: DataFrame
    excluded: DataFrame
    names: tuple[str, ...] = field(default=())


def exclusion_reason(spec: InputSpec, start=None) -> Column:
    """First failing rule of a row, null for a usable row."""
    reason = F.lit(None).cast("string")
    if spec.transform in ("log", "log_difference"):
        reason = F.when(F.col("value") <= 0, F.lit("nonpositive_log"))
    reason = (
        F.when(~F.coalesce(F.col("status").isin(*spec.statuses), F.lit(False)), F.lit("status"))
        .when(F.col("value").isNull(), F.lit("missing_value"))
        .otherwise(reason)
    )
    if start is not None:
        reason = F.when(F.col("date") < F.lit(start).cast("date"), F.lit("before_start")).otherwise(reason)
    return reason


def eligible_observations(df: DataFrame, spec: InputSpec, start=None) -> DataFrame:
    """The input with a ``reason`` column; rows without one are kept."""
    return df.withColumn("reason", exclusion_reason(spec, start))


def period_lag(df: DataFrame, calendar: DataFrame, n: int, frequency: str, by=()) -> DataFrame:
    """Move values to the loaded date ``n`` periods later, within ``by``.

    ``calendar(*by, date)`` holds every loaded date, also those whose own value was
    excluded.  Rows without such a date keep a null date; a target that is not
    after its source is an error.
    """
    targets = calendar.select(
        *by, cal.period_index("date", frequency).alias("_idx"), F.col("date").alias("_target")
    ).groupBy(*by, "_idx").agg(F.max("_target").alias("_target"))
    moved = df.withColumn("_idx", cal.period_index("date", frequency) + n)
    joined = moved.join(targets, [*by, "_idx"], "left")
    target = F.when(
        F.col("_target") <= F.col("source_date"),
        F.raise_error(F.lit("Lag introduced future information")).cast("date"),
    ).otherwise(F.col("_target"))
    return joined.withColumn("date", target).drop("_idx", "_target")


def prepare(df: DataFrame, spec: InputSpec, start=None, by=()) -> DataFrame:
    """Status rules, transformation and lag of one input, reasons kept."""
    marked = eligible_observations(df.select(*by, "date", "value", "status"), spec, start)
    v = F.ln("value") if spec.transform.startswith("log") else F.col("value")
    staged = marked.withColumn("v", F.when(F.col("reason").isNull(), v)).withColumn(
        "source_date", F.col("date")
    )
    if spec.transform.endswith("difference"):
        # Excluded rows carry a null v, so they count as an absent period.
        staged = staged.withColumn("_idx", cal.period_index("date", spec.frequency))
        difference = F.col("v") - at_period("v", "_idx", by, -1)
        staged = staged.withColumn("_d", difference).withColumn(
            "reason",
            F.when(F.col("reason").isNull() & F.col("_d").isNull(), F.lit("difference_unavailable"))
            .otherwise(F.col("reason")),
        ).withColumn("v", F.when(F.col("reason").isNull(), F.col("_d"))).drop("_d", "_idx")
    if spec.lag:
        kept = staged.where("reason is null")
        lagged = period_lag(kept, df.select(*by, "date"), spec.lag, spec.frequency, by).withColumn(
            "reason", F.when(F.col("date").isNull(), F.lit("lag_unavailable"))
        )
        staged = lagged.unionByName(staged.where("reason is not null"))
    return staged.select(*by, F.lit(spec.name).alias("input"), "date", "v", "status", "source_date", "reason")


def to_quarters(prepared: DataFrame, how: str, by=()) -> DataFrame:
    """Complete quarters of a prepared monthly input, incomplete ones reasoned."""
    kept = prepared.where("reason is null")
    quarters = to_quarter(kept, how, (*by, "input"), "v").select(
        *by, "input", "date", "v", "status", "source_date",
        F.when(~F.col("complete"), F.lit("incomplete_quarter")).alias("reason"),
    )
    return quarters.unionByName(prepared.where("reason is not null"))


def join_key(date, strategy: str) -> Column:
    """Key on which inputs meet; dates a strategy cannot hold are an error."""
    d = col(date)

    def require(ok: Column, message: str, value: Column) -> Column:
        return F.when(ok, value).otherwise(
            F.raise_error(F.concat(F.lit(message), d.cast("string"))).cast("int")
        )

    if strategy in ("exact_date_inner_join", "lag_then_inner_join"):
        return d
    if strategy == "calendar_year_inner_join":
        return F.year(d)
    if strategy == "fiscal_year_end_inner_join":
        ok = (F.month(d) == 3) & (F.dayofmonth(d) == 31)
        return require(ok, "Fiscal alignment received a non-fiscal-year-end date: ", F.year(d))
    if strategy == "quarter_end_inner_join":
        ok = F.month(d).isin(3, 6, 9, 12)
        return require(ok, "Quarter alignment received a non-quarter-end month: ", F.year(d) * 4 + F.quarter(d) - 1)
    if strategy in QUARTERLY:
        return F.year(d) * 4 + F.quarter(d) - 1
    raise ValueError(f"Unknown alignment strategy: {strategy}")


def row_date(key, strategy: str) -> Column:
    k = col(key)
    if strategy in ("exact_date_inner_join", "lag_then_inner_join"):
        return k
    if strategy == "calendar_year_inner_join":
        return F.make_date(k, F.lit(12), F.lit(31))
    if strategy == "fiscal_year_end_inner_join":
        return F.make_date(k, F.lit(3), F.lit(31))
    return cal.quarter_end((k / 4).cast("int"), F.pmod(k, F.lit(4)) + 1)


def align(inputs: dict[str, DataFrame], specs, strategy: str, start=None, by=()) -> Aligned:
    """Inner join of all inputs on the period key within ``by``, with exclusion counts.

    The prepared inputs are stacked and pivoted by one grouped aggregation on
    the key; a key is complete when every input contributed.  Two rows of one
    input on the same key are an error.
    """
    specs = tuple(specs)
    if set(inputs) != {s.name for s in specs}:
        raise ValueError("Loaded inputs do not match the registered inputs")
    stacked = None
    for spec in specs:
        part = prepare(inputs[spec.name], spec, start, by)
        if strategy in QUARTERLY and spec.frequency == "monthly":
            part = to_quarters(part, QUARTERLY[strategy], by)
        stacked = part if stacked is None else stacked.unionByName(part)

    usable = stacked.where("reason is null").withColumn("key", join_key("date", strategy))
    n_inputs = len(specs)

    def pick(name: str, field_name: str) -> Column:
        return F.max(F.when(F.col("input") == name, F.col(field_name)))

    duplicate = F.raise_error(F.lit("Alignment produced duplicate periods")).cast("double")
    columns = []
    for s in specs:
        rows = F.count(F.when(F.col("input") == s.name, F.lit(1)))
        columns += [
            F.when(rows > 1, duplicate).otherwise(pick(s.name, "v")).alias(s.name),
            pick(s.name, "status").alias(f"{s.name}__status"),
            pick(s.name, "source_date").alias(f"{s.name}__source_date"),
            (rows > 0).alias(f"{s.name}__present"),
        ]
    by_key = usable.groupBy(*by, "key").agg(F.count_distinct("input").alias("_inputs"), *columns)
    complete = F.col("_inputs") == n_inputs
    sample = by_key.where(complete).select(
        *by, row_date("key", strategy).alias("date"),
        *[c for s in specs for c in (s.name, f"{s.name}__status", f"{s.name}__source_date")],
    )
    unmatched = by_key.where(~complete).select(*by, F.explode(F.array(*[
        F.when(F.col(f"{s.name}__present"), F.lit(s.name)) for s in specs
    ])).alias("input")).where("input is not null").select(*by, "input", F.lit("alignment").alias("reason"))
    excluded = exclusion_summary(
        stacked.select(*by, "input", "reason").unionByName(unmatched), by
    )
    return Aligned(sample, excluded, tuple(s.name for s in specs))
