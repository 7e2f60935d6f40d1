"""State-year panels: joins, within transform, clustered slope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clean_double, ratio
from tidemark.operators.growth import lead_year_growth
from tidemark.operators.summaries import exact_median
from tidemark.session import settle

Z95 = 1.96
GATE = {"n": 100, "states": 15, "years": 5}


def panel_join(current: DataFrame, constant: DataFrame, outlay: DataFrame) -> DataFrame:
    """States and fiscal years present in all three sources; only actual outlays."""
    actual = outlay.where("status = 'actual'").select("state", "fy", F.col("value").alias("outlay"))
    return (
        actual.join(current.select("state", "fy", F.col("value").alias("current_value")), ["state", "fy"])
        .join(constant.select("state", "fy", F.col("value").alias("constant_value")), ["state", "fy"])
    )


def panel_observations(current: DataFrame, constant: DataFrame, outlay: DataFrame,
                       scale: float = 10000.0, digits: int = 4) -> DataFrame:
    """x = scaled outlay share, y = growth of the next year, both rounded.

    The next year is looked up in the full constant-price history, before the
    join drops years without an outlay.
    """
    ahead = lead_year_growth(constant.select("state", "fy", "value"), "value")
    grown = ahead.where("next_growth is not null").select("state", "fy", "next_growth", "value")
    joined = panel_join(current, grown.select("state", "fy", "value"), outlay).join(
        grown.select("state", "fy", "next_growth"), ["state", "fy"]
    )
    share = ratio(F.col("outlay") * scale, "current_value")
    return joined.select(
        "state", (F.col("fy")).alias("year"),
        clean_double(share, digits).alias("x"), clean_double("next_growth", digits).alias("y"),
    ).where("x is not null and y is not null")


def two_way_demean(panel: DataFrame, columns=("x", "y"), entity: str = "state",
                   period: str = "year") -> DataFrame:
    """Value minus entity mean minus period mean plus grand mean.

    Means come from grouped aggregates joined back, so neither a large entity
    nor the whole panel is ever gathered into one task.  The panel is read once
    per mean and is settled first.
    """
    return within(settle(panel), columns, entity, period)


def within(panel: DataFrame, columns, entity: str, period: str) -> DataFrame:
    """``two_way_demean`` of a frame that is cheap to read again."""
    def means(key: str, tag: str) -> DataFrame:
        return panel.groupBy(key).agg(*[F.avg(c).alias(f"_{tag}_{c}") for c in columns])

    out = panel.join(means(entity, "e"), entity).join(means(period, "p"), period)
    for c in columns:
        grand = panel.select(F.avg(c)).scalar()
        out = out.withColumn(f"{c}w", F.col(c) - F.col(f"_e_{c}") - F.col(f"_p_{c}") + grand)
    return out.drop(*[f"_{t}_{c}" for t in "ep" for c in columns])


def two_way_fe(panel: DataFrame) -> DataFrame:
    """Within slope with entity-clustered error; one row.

    A cluster's score is Sxy - beta * Sxx, so the errors need only one partial
    sum per cluster once beta is known.  The panel and the cluster sums are read
    several times and are settled first.
    """
    panel = settle(panel.select("state", "year", "x", "y"))
    demeaned = within(panel, ("x", "y"), "state", "year")
    clusters = settle(demeaned.groupBy("state").agg(
        F.sum(F.col("xw") * F.col("yw")).alias("sxy"),
        F.sum(F.col("xw") * F.col("xw")).alias("sxx"),
        F.count(F.lit(1)).alias("rows"),
    ))
    sums = clusters.agg(
        F.sum("sxy").alias("sxy"), F.sum("sxx").alias("sxx"),
        F.sum("rows").alias("n"), F.count(F.lit(1)).alias("states"),
    )
    beta = sums.select(ratio("sxy", "sxx")).scalar()
    score = F.col("sxy") - beta * F.col("sxx")
    meat = clusters.agg(F.sum(score * score)).scalar()
    years = panel.agg(F.count_distinct("year")).scalar()
    g, n = F.col("states"), F.col("n")
    correction = F.when(g > 1, ratio(g, g - 1) * ratio(n - 1, F.greatest(n - 1, F.lit(1))))
    fitted = sums.select(
        ratio("sxy", "sxx").alias("coefficient"),
        F.sqrt(ratio(correction * meat, F.col("sxx") * F.col("sxx"))).alias("clustered_se"),
        "n", "states", years.alias("years"),
    )
    return fitted.select(
        "coefficient", "clustered_se",
        (F.col("coefficient") - F.lit(Z95) * F.col("clustered_se")).alias("ci_low"),
        (F.col("coefficient") + F.lit(Z95) * F.col("clustered_se")).alias("ci_high"),
        "n", "states", "years",
    )


def panel_gate(estimate: DataFrame, required: dict[str, int] = GATE) -> DataFrame:
    """Whether a panel estimate is large enough to publish."""
    ok = F.lit(True)
    for name, least in required.items():
        ok = ok & (F.col(name) >= least)
    return estimate.withColumn("eligible", ok)


def panel_medians(panel: DataFrame) -> DataFrame:
    """Cross-entity median of x and y per year."""
    long = panel.unpivot(["year"], ["x", "y"], "axis", "value")
    medians = exact_median(long, "value", ("year", "axis"), "m")
    return medians.groupBy("year").agg(
        F.max(F.when(F.col("axis") == "x", F.col("m"))).alias("median_x"),
        F.max(F.when(F.col("axis") == "y", F.col("m"))).alias("median_y"),
    )


def regression_segment(points: DataFrame, by=()) -> DataFrame:
    """End points of the least-squares line, none for n < 2 or constant x."""
    both = points.where("x is not null and y is not null")
    fit = both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        ratio(F.covar_pop("x", "y"), F.var_pop("x")).alias("slope"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
    ).where("n >= 2 and slope is not null")
    intercept = F.col("my") - F.col("slope") * F.col("mx")
    ends = F.array(*[
        F.struct(F.lit(end).alias("end"), F.col(x).alias("x"),
                 (intercept + F.col("slope") * F.col(x)).alias("y"))
        for end, x in (("low", "x0"), ("high", "x1"))
    ])
    return fit.select(*by, F.inline(ends))


def padded_domain(panel: DataFrame, column: str) -> DataFrame:
    """Axis range with five percent padding on both sides."""
    low, high = F.min(column), F.max(column)
    span = F.when(high - low != 0, high - low).when(high != 0, F.abs(high)).otherwise(F.lit(1.0))
    return panel.agg((low - span * 0.05).alias("low"), (high + span * 0.05).alias("high"))


def panel_means(panel: DataFrame, state: str | None = None, year: int | None = None) -> DataFrame:
    """Means of x and y over the selected part of the panel."""
    chosen = panel
    if state is not None:
        chosen = chosen.where(F.col("state") == state)
    if year is not None:
        chosen = chosen.where(F.col("year") == year)
    return chosen.agg(
        F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.count(F.lit(1)).alias("n")
    )
