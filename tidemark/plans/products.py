"""Analytical products composed from the operators.

Every function is lazy: asking for one product plans only that product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.scalars import col, pct, status_from_year
from tidemark.operators import correlation as corr
from tidemark.operators import market as mk
from tidemark.operators import panel as pn
from tidemark.operators.growth import (
    growth_gap, growth_prev_nonnull, pct_change, shift_fiscal_year, trailing_consecutive_sum,
    trailing_deviation, yoy_exact,
)
from tidemark.operators.lagged import (
    lag_correlations, lag_ladder, lag_pairs, window_anchors, window_return,
)
from tidemark.operators.reshape import densify_years, union_records
from tidemark.operators.rules import classify
from tidemark.operators.summaries import (
    capital_resilience, delivery_quality, fiscalise, group_median, monthly_flows,
)
from tidemark.operators.vintages import (
    assemble_vintages, bridge, execution_records, quality_join, ratio_series,
)

PANDEMIC_YEARS = (2021, 2022)
MARKET_LAGS = (0, 6, 12)
MARKET_LEADS = (3, 6, 12)
YEAR_LAGS = (0, 1, 2)
GROWTH_FIELDS = ("revenue", "ebitda", "capex", "net_ppe", "debt")

# Lower and upper bound per published series; null is open.
EXECUTION_BOUNDS = (
    ("actual_capex_pct_gdp", 0.0, None),
    ("actual_capex_pct_total_expenditure", 0.0, 100.0),
    ("capex_execution_ratio", 0.0, None),
    ("capex_budget_estimate", 0.0, None),
    ("capex_revised_estimate", 0.0, None),
    ("capex_actual", 0.0, None),
)


def execution(snapshots: DataFrame, gdp: DataFrame | None = None) -> DataFrame:
    """Budget, revised, actual, shares, execution and nominal growth."""
    records = execution_records(assemble_vintages(snapshots), gdp)
    growth = growth_prev_nonnull(
        records.where("indicator = 'capex_actual'"), "value", ("entity",), "date", "growth"
    ).select(
        "date", "entity", F.lit("nominal_capex_growth").alias("indicator"),
        F.col("growth").alias("value"), F.lit("percent").alias("unit"), "status", "period_label",
    )
    return records.unionByName(growth)


def annual_series(reference: DataFrame, dataset: str) -> DataFrame:
    """One annual reference dataset as records dated 31 March."""
    return reference.where(F.col("dataset") == dataset).select(
        F.make_date("fy", F.lit(3), F.lit(31)).alias("date"), F.lit("IND").alias("entity"),
        F.col("series").alias("indicator"), "value", "status",
        cal.fy_label(F.col("fy") - 1).alias("period_label"),
    )


def market_performance(prices: DataFrame, benchmark: str, required) -> tuple[DataFrame, DataFrame]:
    """Monthly performance rows and the per-market summary."""
    performance = mk.sector_performance(prices, benchmark, required)
    return performance, mk.market_summary(performance)


def lag_analysis(driver: DataFrame, performance: DataFrame, targets, benchmark: str, control: str,
                 real_outcome: DataFrame | None = None) -> DataFrame:
    """Lag and lead correlations of an annual driver with market returns.

    ``driver(date, driver)`` holds growth dated at fiscal year ends.  Targets
    enter by excess return, the benchmark by raw return, and every target once
    more relative to the control.
    """
    # One pass over the performance rows yields every return series.
    staged = mk.with_benchmark(performance, control, "raw_return", "_control")
    is_target = F.col("market").isin(list(targets))

    def entry(condition, name, ret):
        return F.when(condition, F.struct(name.alias("series"), ret.alias("ret")))

    market = F.col("market")
    entries = F.array(
        entry(is_target, market, F.col("excess")),
        entry(market == benchmark, market, F.col("raw_return")),
        entry(is_target, F.concat(market, F.lit(f"_VS_{control}")), F.col("raw_return") - F.col("_control")),
    )
    returns = staged.select("date", F.explode(F.array_compact(entries)).alias("e")).select(
        "date", F.col("e.series").alias("market"), "e.ret"
    )
    anchors = driver.where(F.col("driver").isNotNull())
    windows = window_anchors(anchors, MARKET_LAGS, "forward").unionByName(
        window_anchors(anchors, MARKET_LEADS, "backward")
    )
    leads = F.when(F.col("direction") == "forward", F.lit("capex_leads")).otherwise("market_leads")
    pairs = window_return(windows, returns).join(
        anchors.select(F.col("date").alias("anchor"), "driver"), "anchor"
    ).select(
        F.col("market").alias("series"), F.col("offset").alias("lag"),
        F.lit("months").alias("lag_unit"), F.lit("market").alias("outcome_type"),
        leads.alias("direction"), "driver", F.col("window_return").alias("outcome"),
        F.year("anchor").cast("int").alias("year"),
    )
    if real_outcome is not None:
        real = lag_pairs(driver, real_outcome, YEAR_LAGS).select(
            F.col("outcome_key").alias("series"), "lag", F.lit("years").alias("lag_unit"),
            F.lit("real_economy").alias("outcome_type"), F.lit("capex_leads").alias("direction"),
            "driver", "outcome", "year",
        )
        pairs = pairs.unionByName(real)
    keys = ("series", "direction", "lag", "lag_unit", "outcome_type")
    table = lag_correlations(pairs, keys, PANDEMIC_YEARS)
    # The annual real-economy rows carry no sensitivity estimate.
    return table.withColumn(
        "pearson_excluding",
        F.when(F.col("outcome_type") == "market", F.col("pearson_excluding")),
    )


def private_response(accounts: DataFrame, government: DataFrame, capacity: DataFrame) -> DataFrame:
    """Private investment shares, lagged public investment, utilisation (E5)."""
    base = accounts.withColumn("date", cal.fy_end_date("fy_start"))
    entries = F.array(
        F.struct(F.lit("private_corporate_gfcf_pct_gdp").alias("indicator"),
                 pct("private_gfcf", "nominal_gdp").alias("value")),
        F.struct(F.lit("private_share_total_gfcf").alias("indicator"),
                 pct("private_gfcf", "total_gfcf").alias("value")),
    )
    shares = base.select("date", F.inline(entries)).select(
        "date", "indicator", "value", F.lit("revised").alias("status")
    )
    lagged = shift_fiscal_year(
        government.where("indicator = 'actual_capex_pct_gdp'"), "public_capex_lagged"
    ).select("date", "indicator", "value", "status")
    quarters = capacity.select(
        cal.fiscal_quarter_end("fy_start", "quarter").alias("date"),
        F.lit("manufacturing_capacity_utilisation").alias("indicator"),
        F.col("cu").alias("value"), F.lit("provisional").alias("status"),
    )
    return union_records(shares, lagged, quarters)


def fiscal_sustainability(fiscal: DataFrame, government: DataFrame) -> DataFrame:
    """Debt, interest and balance records with the allocation bridge."""
    share = government.where("indicator = 'actual_capex_pct_total_expenditure'").select(
        "date", F.lit("actual_capex_pct_expenditure").alias("indicator"), "value", "status"
    )
    interest = fiscal.where("indicator = 'interest_payments_pct_expenditure'")
    linked = bridge(share, interest, "capex_to_interest_allocation_ratio")
    return fiscal.select("date", "indicator", "value", "status").unionByName(linked)


def corporate_fundamentals(fundamentals: DataFrame, metrics=GROWTH_FIELDS) -> DataFrame:
    """Group-year medians of company growth.

    All metrics grow over one window and are unpivoted before the medians, so
    the statements are read once.
    """
    grown = fundamentals
    for field in metrics:
        grown = pct_change(grown, field, ("company_key",), "fy", f"{field}_growth", 100.0)
    names = [f"{field}_growth" for field in metrics]
    long = grown.unpivot(["grp", "fy"], names, "metric", "value")
    return group_median(long, "value", ("grp", "fy", "metric")).withColumnRenamed("median_value", "value")


def project_quality(status: DataFrame, cost: DataFrame) -> DataFrame:
    """Delivery shares and overruns per sector and year."""
    return delivery_quality(quality_join(status, cost))


def state_evaluation(current: DataFrame, constant: DataFrame, outlay: DataFrame,
                     scale: float = 10000.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Panel observations, gated estimate and yearly medians."""
    panel = pn.panel_observations(current, constant, outlay, scale)
    return panel, pn.panel_gate(pn.two_way_fe(panel)), pn.panel_medians(panel)


def crowding_in(driver: DataFrame, annual: DataFrame, quarterly: DataFrame | None = None) -> DataFrame:
    """Distributed-lag ladder; quarterly outcomes are brought to fiscal years."""
    outcomes = annual.select("outcome_key", "date", "outcome")
    if quarterly is not None:
        yearly = fiscalise(quarterly, "outcome", ("outcome_key",)).select("outcome_key", "date", "outcome")
        outcomes = outcomes.unionByName(yearly)
    return lag_ladder(driver, outcomes)


def verdict(records: DataFrame, lag_corr: DataFrame, benchmark_label: str, **names) -> DataFrame:
    """Hypothesis statuses."""
    return classify(records, lag_corr, benchmark_label, **names)


def digital_adoption(volumes: DataFrame, population: DataFrame, gdp: DataFrame) -> DataFrame:
    """Per-capita volume, ticket size and trailing value over GDP.

    ``volumes(year, month, volume, value)``; denominators are (year, value).
    """
    dated = volumes.withColumn("date", cal.month_end("year", "month"))
    staged = trailing_consecutive_sum(dated, 12, "value", (), out="trailing_value")
    joined = staged.join(population.select("year", F.col("value").alias("_pop")), "year", "left").join(
        gdp.select("year", F.col("value").alias("_gdp")), "year", "left"
    )
    return joined.select(
        "date",
        F.when(F.col("_pop") > 0, F.try_divide(F.col("volume").cast("double"), "_pop")).alias("per_capita"),
        F.when(F.col("volume") > 0, F.try_divide(F.col("value"), F.col("volume").cast("double"))).alias("average_value"),
        F.when(F.col("_gdp") > 0, pct("trailing_value", "_gdp")).alias("value_pct_gdp"),
    )


def tax_gap(tax: DataFrame, gdp: DataFrame) -> DataFrame:
    return growth_gap(tax, gdp)


def external_competitiveness(reer: DataFrame, exports: DataFrame, balance: DataFrame,
                             gdp: DataFrame, window: int = 60) -> DataFrame:
    """Exchange-rate deviation, export growth and current account over GDP."""
    deviation = trailing_deviation(reer, window).select(
        "date", F.lit("reer_deviation_pct").alias("indicator"), F.col("deviation").alias("value")
    )
    growth = yoy_exact(exports).select(
        "date", F.lit("non_oil_export_growth").alias("indicator"), F.col("yoy").alias("value")
    )
    account = ratio_series(balance, gdp).select(
        "date", F.lit("current_account_pct_gdp").alias("indicator"), "value"
    )
    out = union_records(deviation, growth, account)
    return out.withColumn("status", status_from_year(F.year("date"), {2024: "provisional"}))


def flow_resilience(flows: DataFrame) -> DataFrame:
    """Monthly flows, trailing sums and the offset ratio."""
    return capital_resilience(monthly_flows(flows))


def annual_records(df: DataFrame, period_kind: str, indicator: str, keys=()) -> DataFrame:
    """Academic or calendar years of (keys, year, value) as dated records."""
    y = col("year")
    if period_kind == "academic":
        date, start = cal.fy_end_date(y), cal.fy_start_date(y)
        label = F.format_string("AY%d-%02d", y, F.pmod(y + 1, F.lit(100)))
    else:
        date = F.make_date(y, F.lit(12), F.lit(31))
        start, label = F.make_date(y, F.lit(1), F.lit(1)), y.cast("string")
    return df.select(
        *keys, date.alias("date"), F.lit(indicator).alias("indicator"), "value",
        label.alias("period_label"), start.alias("period_start"), date.alias("period_end"),
    )


def peer_comparison(country_year: DataFrame, start: int, end: int) -> DataFrame:
    """Dense years per country with growth to the previous year."""
    dense = densify_years(country_year, start, end)
    return pct_change(dense, "value", ("entity",), "year", "growth", 100.0)


def currency_statistics(spark: SparkSession, prices: DataFrame, markets, events: DataFrame,
                        window: int = 60) -> dict[str, DataFrame]:
    """The currency bundle: rebased, volatility, pairs, events, rolling."""
    pairs = corr.unordered_pairs(spark, markets)
    complete = mk.drop_any(prices)
    aligned = corr.returns_on_common_dates(prices, pairs)
    return {
        "rebased": mk.rebase(complete),
        "volatility": mk.volatility_table(prices),
        "decomposition": mk.cross_decomposition(prices, pairs),
        "correlation": corr.fx_equity_correlation(prices, pairs),
        "rolling": corr.rolling_correlation(aligned, window),
        "events": mk.event_window_change(prices, events),
    }


def growth_of(df: DataFrame, value: str = "value", order: str = "date") -> DataFrame:
    """Driver frame (date, driver) of percent growth over the previous row."""
    return pct_change(df, value, (), order, "driver", 100.0).select("date", "driver")


