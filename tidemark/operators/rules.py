"""Rule-based classification of hypotheses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTENSITY = ("actual_capex_pct_gdp", "actual_capex_pct_total_expenditure")
CONVERSION = ("private_corporate_gfcf_pct_gdp", "manufacturing_capacity_utilisation")
FISCAL = ("general_government_debt_pct_gdp", "interest_payments_pct_revenue")
MIN_PAIRS = 4
POSITIVE_SHARE = 2 / 3


def classify(records: DataFrame, lag_corr: DataFrame, benchmark_label: str,
             intensity=INTENSITY, conversion=CONVERSION, fiscal=FISCAL) -> DataFrame:
    """One status per hypothesis.

    ``records(indicator, date, value)``; ``lag_corr(label, direction,
    outcome_type, pearson, n)``, of which only driver-leads market rows outside
    the benchmark count.
    """
    names = [*intensity, *conversion, *fiscal]
    ends = records.where(F.col("indicator").isin(names) & F.col("value").isNotNull()).groupBy().agg(*[
        aggregate
        for i, name in enumerate(names)
        for aggregate in (
            F.count(F.when(F.col("indicator") == name, F.lit(1))).alias(f"n{i}"),
            F.min_by(F.when(F.col("indicator") == name, F.col("value")),
                     F.when(F.col("indicator") == name, F.col("date"))).alias(f"first{i}"),
            F.max_by(F.when(F.col("indicator") == name, F.col("value")),
                     F.when(F.col("indicator") == name, F.col("date"))).alias(f"last{i}"),
        )
    ])
    usable = (
        F.col("pearson").isNotNull() & (F.col("n") >= MIN_PAIRS)
        & (F.coalesce("direction", F.lit("capex_leads")) == "capex_leads")
        & (F.col("outcome_type") == "market") & (F.col("label") != benchmark_label)
    )
    share = lag_corr.where(usable).select(
        F.avg(F.when(F.col("pearson") > 0, 1.0).otherwise(0.0))
    ).scalar()

    def rose(i: int):
        return F.col(f"last{i}") > F.col(f"first{i}")

    def have(i: int, n: int):
        return F.col(f"n{i}") >= n

    staged = ends.withColumn("_share", share)
    supported = F.lit("supported")
    rules = {
        "capex_intensity": F.when(have(0, 2) & have(1, 2) & rose(0) & rose(1), supported).otherwise("unsupported"),
        "sector_transmission": F.when(F.col("_share") >= POSITIVE_SHARE, supported)
        .when(F.col("_share") > 0, F.lit("partially_supported")).otherwise("inconclusive"),
        "real_economy_conversion": F.when(~(have(2, 4) & have(3, 4)), F.lit("inconclusive"))
        .when(rose(2) & rose(3), supported).otherwise("partially_supported"),
        "fiscal_sustainability": F.when(have(4, 1) & have(5, 1), F.lit("partially_supported")).otherwise("inconclusive"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("hypothesis"), v.alias("status")) for k, v in rules.items()])
    return staged.select(F.inline(rows))
