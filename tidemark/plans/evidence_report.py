"""The registered evidence report (E18): align, gate, fit, diagnose, adjust, grade.

One analysis is a small dated sample, so its fits run as grouped Spark
aggregations over all robustness variants at once: a variant is a tag, and the
tagged copies of the sample are fitted together.  A sample has one row per
fiscal year or month, so its lags take a window, not blocks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import effect, effect_error
from tidemark.operators import evidence as ev
from tidemark.operators import regression as rg
from tidemark.operators.alignment import Aligned, InputSpec, align
from tidemark.operators.filters import all_status, drop_most_influential, exclude_range
from tidemark.operators.reshape import union_records
from tidemark.session import settle

COVID_YEARS = ("2021-03-31", "2022-03-31")


@dataclass(frozen=True)
class EvidenceSpec:
    """A registered analysis: inputs, design, gates and checks."""

    key: str
    inputs: tuple[InputSpec, ...]
    alignment: str
    terms: tuple[str, ...]
    focal: str
    expected: str
    max_lag: int
    family: str
    diagnostics: tuple[str, ...]
    robustness: tuple[str, ...]
    min_observations: int = 30
    min_residual_df: int = 20
    scale: str = "identity"
    secondary: tuple[tuple[str, str], ...] = ()
    start: str | None = None
    break_date: str | None = None
    covid_dates: tuple[str, ...] = ()
    later_start: str = "2018-04-30"
    disruption: tuple[str, str] = ("2020-03-31", "2020-06-30")

    @property
    def dependent(self) -> str:
        return next(i.name for i in self.inputs if i.role == "dependent")

    def names(self, role: str) -> tuple[str, ...]:
        return tuple(i.name for i in self.inputs if i.role == role)


# Published keys (fixed values).
FISCAL_DIAGNOSTICS = ("residual_degrees_of_freedom", "condition_number", "residual_autocorrelation",
                      "stationarity", "influential_observation")
FISCAL_ROBUSTNESS = ("exclude_covid_fiscal_years", "actual_status_only", "hac_max_lags_1",
                     "exclude_most_influential", "parsimonious_bivariate")
TREND_DIAGNOSTICS = ("residual_degrees_of_freedom", "condition_number", "residual_autocorrelation",
                     "influential_observation", "stability")
TREND_ROBUSTNESS = ("start_date_2018_04", "exclude_pandemic_disruption_months", "linear_level_trend",
                    "hac_max_lags_6")

DEBT_INTEREST = EvidenceSpec(
    key="debt-interest-burden-change",
    inputs=(
        InputSpec("interest_burden_change", "fiscal_year", "dependent", transform="difference"),
        InputSpec("lagged_general_government_debt", "fiscal_year", "focal", lag=1),
        InputSpec("lagged_primary_balance", "fiscal_year", "control", lag=1),
    ),
    alignment="lag_then_inner_join",
    terms=("intercept", "lagged_general_government_debt", "lagged_primary_balance", "trend"),
    focal="lagged_general_government_debt", expected="positive", max_lag=2,
    family="fiscal_capacity_primary", diagnostics=FISCAL_DIAGNOSTICS, robustness=FISCAL_ROBUSTNESS,
    secondary=(("lagged_primary_balance", "identity"), ("trend", "identity")), covid_dates=COVID_YEARS,
)
BALANCE_DEBT = EvidenceSpec(
    key="primary-balance-debt-change",
    inputs=(
        InputSpec("debt_change", "fiscal_year", "dependent", transform="difference"),
        InputSpec("lagged_primary_balance", "fiscal_year", "focal", lag=1),
        InputSpec("lagged_debt_change", "fiscal_year", "control", transform="difference", lag=1),
    ),
    alignment="lag_then_inner_join",
    terms=("intercept", "lagged_primary_balance", "lagged_debt_change", "covid_fy2020_22"),
    focal="lagged_primary_balance", expected="negative", max_lag=2,
    family="fiscal_capacity_primary", diagnostics=FISCAL_DIAGNOSTICS, robustness=FISCAL_ROBUSTNESS,
    secondary=(("lagged_debt_change", "identity"), ("covid_fy2020_22", "identity")), covid_dates=COVID_YEARS,
)
ADOPTION_TREND = EvidenceSpec(
    key="upi-adoption-trend",
    inputs=(InputSpec("log_upi_transactions_per_capita", "monthly", "dependent", ("actual",), "log"),),
    alignment="exact_date_inner_join",
    terms=rg.SEGMENTED_TERMS, focal="monthly_trend", expected="positive", max_lag=12,
    family="digital_integration_primary", diagnostics=TREND_DIAGNOSTICS, robustness=TREND_ROBUSTNESS,
    min_observations=36, scale="annual_log_percent", start="2017-04-30", break_date="2020-04-30",
    secondary=(("level_shift", "log_percent"), ("slope_shift", "annual_log_percent")),
)


# Variants that keep the design and change the rows.
ROW_VARIANTS = ("exclude_covid_fiscal_years", "actual_status_only", "exclude_most_influential",
                "start_date_2018_04", "exclude_pandemic_disruption_months")


@dataclass(frozen=True)
class Report:
    """Result tables of one analysis, all keyed by analysis_key."""

    aligned: Aligned
    eligibility: DataFrame
    estimates: DataFrame
    diagnostics: DataFrame
    robustness: DataFrame


def fiscal_columns(sample: DataFrame, spec: EvidenceSpec, by=()) -> DataFrame:
    """Design columns that depend on the rows of a variant."""
    out = rg.with_trend(sample, F.year("date"), "trend", by)
    return rg.exceptional_dates(out, spec.covid_dates or COVID_YEARS, "covid_fy2020_22")


def _focal_rows(fit: rg.Fit, max_lag: int, focal: str) -> DataFrame:
    return rg.hac(fit, max_lag).where(F.col("term") == focal)


def _variant(spec: EvidenceSpec, sample: DataFrame, key: str, influence: Callable[[], DataFrame]) -> DataFrame:
    """Rows of a robustness variant; design changes are handled by the caller."""
    if key == "exclude_covid_fiscal_years":
        return sample.where(~F.col("date").isin([F.lit(d).cast("date") for d in spec.covid_dates or COVID_YEARS]))
    if key == "actual_status_only":
        return all_status(sample, [c for c in sample.columns if c.endswith("__status")])
    if key == "exclude_most_influential":
        return drop_most_influential(influence()).select(*sample.columns)
    if key == "start_date_2018_04":
        return sample.where(F.col("date") >= F.lit(spec.later_start).cast("date"))
    if key == "exclude_pandemic_disruption_months":
        return exclude_range(sample, *spec.disruption)
    return sample


def prepare(spec: EvidenceSpec, inputs: dict[str, DataFrame]) -> Aligned:
    """The aligned sample of an analysis and its exclusion counts."""
    return align(inputs, spec.inputs, spec.alignment, spec.start)


def gates(spec: EvidenceSpec, sample: DataFrame) -> DataFrame:
    """Eligibility row of one analysis."""
    return ev.eligibility(
        sample, dependent=[spec.dependent], focal=spec.names("focal"), controls=spec.names("control"),
        min_observations=spec.min_observations, min_pairs=spec.min_observations,
        parameters=len(spec.terms), min_residual_df=spec.min_residual_df,
    ).withColumns({"analysis_key": F.lit(spec.key), "family": F.lit(spec.family)})


def designed(spec: EvidenceSpec, df: DataFrame, by=()) -> DataFrame:
    """Design columns, which may depend on the first row of each variant."""
    if spec.break_date is not None:
        return rg.segmented_design(df, spec.break_date, by)
    return fiscal_columns(df, spec, by)


def robustness_fits(spec: EvidenceSpec, sample: DataFrame, fit: rg.Fit) -> DataFrame:
    """Focal rows of every registered variant, null where it could not be fitted.

    Variants that only change the rows are tagged, stacked and fitted together.
    """
    y, by = spec.dependent, ("specification",)

    def tagged(keys) -> DataFrame:
        parts = [
            _variant(spec, sample, k, lambda: rg.cooks(fit)).withColumn("specification", F.lit(k)) for k in keys
        ]
        return designed(spec, union_records(*parts), by)

    def focal(fitted: rg.Fit, key: str | None = None, max_lag: int = spec.max_lag) -> DataFrame:
        rows = _focal_rows(fitted, max_lag, spec.focal)
        return rows if key is None else rows.withColumn("specification", F.lit(key))

    covid = "exclude_covid_fiscal_years"
    drops_term = "covid_fy2020_22" in spec.terms
    shared = [k for k in spec.robustness if k in ROW_VARIANTS and not (drops_term and k == covid)]
    tables = []
    if shared:
        tables.append(focal(rg.ols(tagged(shared), y, spec.terms, by)))
    if drops_term and covid in spec.robustness:
        # Without those years the indicator is constant, so it leaves the design.
        kept = tuple(t for t in spec.terms if t != "covid_fy2020_22")
        tables.append(focal(rg.ols(tagged([covid]), y, kept, by)))
    for k in spec.robustness:
        if k.startswith("hac_max_lags_"):
            tables.append(focal(fit, k, int(k.rsplit("_", 1)[1])))
        elif k == "parsimonious_bivariate":
            tables.append(focal(rg.ols(designed(spec, sample), y, ("intercept", spec.focal), blocked=False), k))
        elif k == "linear_level_trend":
            level = designed(spec, sample).withColumn("_level", F.exp(y))
            tables.append(focal(rg.ols(level, "_level", spec.terms, blocked=False), k))
    fields = ("specification", "coef", "se", "t", "p_value", "ci_low", "ci_high", "n")
    fitted = union_records(*[t.select(*fields) for t in tables])
    names = sample.sparkSession.createDataFrame([(k,) for k in spec.robustness], "specification string")
    return names.join(fitted, "specification", "left")


def on_scale(df: DataFrame, scale: str, special: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """Estimates on their reporting scale.

    ``special`` names the (column, value) rows that have a scale of their own.
    """
    def choose(fn, *args):
        out = fn(*args, scale)
        for (column, value), own in (special or {}).items():
            out = F.when(F.col(column) == value, fn(*args, own)).otherwise(out)
        return out

    return df.withColumns({
        "value": choose(effect, "coef"), "low": choose(effect, "ci_low"), "high": choose(effect, "ci_high"),
        "error": choose(effect_error, "coef", "se"),
    })


def diagnostic_values(spec: EvidenceSpec, sample: DataFrame, fit: rg.Fit) -> DataFrame:
    """One wide row of the registered diagnostic values."""
    parts = [rg.breusch_godfrey(fit, max(1, spec.max_lag)).select("bg_p_value"), rg.max_cooks(fit)]
    if "stationarity" in spec.diagnostics:
        parts.append(rg.adf(fit.rows, blocked=False).select("adf_p_value"))
    if "stability" in spec.diagnostics:
        parts.append(rg.stability_gate(
            sample, spec.dependent, spec.terms, spec.focal, spec.expected, 12, 36,
            rebuild=lambda df, keys: designed(spec, df, keys), blocked=False,
        ).select("stable"))
    row = fit.groups.select("df", "condition", F.lit(spec.key).alias("analysis_key"))
    for part in parts:
        row = row.join(part.withColumn("analysis_key", F.lit(spec.key)), "analysis_key", "left")
    return row


def run(spec: EvidenceSpec, inputs: dict[str, DataFrame]) -> Report:
    """All result tables of one analysis (estimates only when eligible).

    The aligned sample and the main fit are read by many tests, so each is
    written once to the shared folder and its sources are not scanned again.
    """
    aligned = prepare(spec, inputs)
    sample = settle(aligned.sample)
    gate = settle(gates(spec, sample))
    passed = gate.where("eligible").select("analysis_key")
    key = F.lit(spec.key).alias("analysis_key")
    fit = rg.ols(designed(spec, sample), spec.dependent, spec.terms, blocked=False).settle()
    reported = rg.hac(fit, spec.max_lag).where(F.col("term").isin(spec.focal, *dict(spec.secondary)))
    scaled = on_scale(reported, spec.scale, {("term", t): own for t, own in spec.secondary})
    estimates = scaled.select(
        key, F.lit(spec.family).alias("family"), "term", (F.col("term") == spec.focal).alias("is_focal"),
        F.lit(spec.expected).alias("expected"), "value", F.col("error").alias("se"),
        F.col("low").alias("ci_low"), F.col("high").alias("ci_high"), "p_value", "n",
    )
    level = {("specification", "linear_level_trend"): "annual_level"}
    robustness = on_scale(robustness_fits(spec, sample, fit), spec.scale, level).select(
        key, "specification", "value", "p_value", "n",
        ev.robustness_status("p_value", "value", spec.expected).alias("status"),
    )
    diagnostics = ev.diagnostic_flags(diagnostic_values(spec, sample, fit), spec.min_residual_df).where(
        F.col("key").isin(*spec.diagnostics)
    )
    return Report(aligned, gate, *[
        settle(t.join(passed, "analysis_key", "left_semi")) for t in (estimates, diagnostics, robustness)
    ])


def combine(reports) -> DataFrame:
    """Family-adjusted, graded results of several analyses, one row each.

    An analysis that failed its gates stays in its family with p = 1.
    """
    reports = list(reports)

    gate = union_records(*[r.eligibility for r in reports])
    estimates = union_records(*[r.estimates for r in reports]).where("is_focal")
    registered = gate.select("analysis_key", "family", "eligible", "n", "start_date", "end_date")
    focal = registered.join(estimates.drop("n", "family"), "analysis_key", "left")
    adjusted = ev.bh_adjust(focal).where("eligible")
    graded = ev.grade(
        adjusted.select("analysis_key", "value", "adjusted_p_value", "expected"),
        union_records(*[r.diagnostics for r in reports]), union_records(*[r.robustness for r in reports]),
    )
    full = registered.join(
        adjusted.select("analysis_key", "term", "value", "se", "ci_low", "ci_high", "p_value", "adjusted_p_value"),
        "analysis_key", "left",
    ).join(graded, "analysis_key", "left")
    return full.withColumns({
        "status": F.when(F.col("eligible"), F.col("status")).otherwise("insufficient_data"),
        "grade": F.when(F.col("eligible"), F.col("grade")).otherwise("not_assessed"),
    })
