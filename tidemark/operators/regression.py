"""Least squares with Newey-West errors and its diagnostics.

Shape of every fit: Spark aggregates the design's covariances per group in one
pass that merges centred partial sums, a k-by-k solve turns them into
coefficients, and everything row-wise (residuals, lags, leverage) goes back to
column expressions and windows on centred columns.  A
group is one analysis or variant; its windows run over its dated sample.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tidemark.functions import numerics as nx
from tidemark.functions.numerics import gram_rank, solve_scaled, unpack
from tidemark.functions.scalars import col, ratio
from tidemark.operators.blocks import PLACE, placed, with_lags
from tidemark.session import settle

INTERCEPT = "intercept"


@dataclass(frozen=True)
class Fit:
    """A fitted design: one row per group, and the rows with residuals."""

    groups: DataFrame
    rows: DataFrame
    y: str
    terms: tuple[str, ...]
    by: tuple[str, ...]
    order: str
    blocked: bool

    def lagged(self, rows: DataFrame, lags) -> DataFrame:
        """Lags of ``out: (column, lag)`` along each series: see ``lag_columns``."""
        return lag_columns(rows, self.by, self.order, lags, self.blocked)

    def settle(self) -> Fit:
        """Groups and rows as written tables, for a fit that many tests read."""
        rows = placed(self.rows, self.by, self.order) if self.blocked else self.rows
        kept = (*self.by, self.order, *self.terms, self.y, *BOOKKEEPING)
        kept += tuple(c for c in rows.columns if c not in kept)
        return replace(self, groups=settle(self.groups), rows=settle(rows.select(*kept)))


# Columns that a fit adds to its rows.
BOOKKEEPING = ("beta", "means", "gamma", "core", "df", "fitted", "resid")


def lag_columns(rows: DataFrame, by, order: str, lags, blocked: bool) -> DataFrame:
    """Lags per series: in blocks with a halo, or in one window per group.

    Each way gives the same values.  A series without keys has no other split,
    so callers take blocks for it unless told otherwise.
    """
    if blocked:
        return with_lags(rows, by, order, lags)
    w = W.partitionBy(*by).orderBy(order)
    return rows.withColumns({out: F.lag(c, lag).over(w) for out, (c, lag) in lags.items()}) if lags else rows


def grouped(df: DataFrame, by, *aggregates: Column) -> DataFrame:
    return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)


def whole_columns(df: DataFrame, columns) -> DataFrame:
    """Columns as doubles in which a null is not-a-number.

    So a group with an incomplete or non-finite row has no finite system and is
    refused as a whole, never fitted to sums that skip different rows.
    """
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in dict.fromkeys(columns)})


def paired(df: DataFrame, by, left, right=None) -> DataFrame:
    """Rows ``_pos, _a, _b`` of all pairs of a left with a right column.

    With one list: its pairs i <= j, row-major.  Pairs are rows, so a wide
    design aggregates by the same small code as a narrow one.
    """
    left = list(left)
    pairs = [(a, b) for a in left for b in right] if right else [(a, b) for i, a in enumerate(left) for b in left[i:]]
    entries = F.array(*[F.struct(F.col(a).alias("_a"), F.col(b).alias("_b")) for a, b in pairs])
    return df.select(*by, F.posexplode(entries).alias("_pos", "_p")).select(*by, "_pos", "_p._a", "_p._b")


def summed_products(df: DataFrame, by, left, right=None, out: str = "packed") -> DataFrame:
    """Sums of products per group as one array, row-major: see ``paired``."""
    by = list(by)
    sums = paired(df, by, left, right).groupBy(*by, "_pos").agg(F.sum(F.col("_a") * F.col("_b")).alias("_p"))
    return grouped(sums, by, F.sort_array(F.collect_list(F.struct("_pos", "_p")))["_p"].alias(out))


def packed_gram(df: DataFrame, by, terms, y: str) -> DataFrame:
    """Packed Gram matrix of (1, terms..., y) per group, not-a-number where a value is missing."""
    return summed_products(whole_columns(df, (*terms, y)).withColumn("_1", F.lit(1.0)), by, ["_1", *terms, y])


def packed_moments(df: DataFrame, by, terms, y: str) -> DataFrame:
    """``n, mean, cov`` per group: means and packed covariances of (terms..., y).

    Spark's covariance updates and merges centred sums, so one pass keeps the
    digits that sums of raw products lose where a mean is large.
    """
    by = list(by)
    names = [t for t in terms if t != INTERCEPT] + [y]
    ends = [len(names) * i - i * (i - 1) // 2 for i in range(len(names))]
    moments = paired(whole_columns(df, names), by, names).groupBy(*by, "_pos").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("_a").alias("_mean"), F.covar_pop("_a", "_b").alias("_cov"))
    packed = F.sort_array(F.collect_list(F.struct("_pos", "_mean", "_cov")))
    return grouped(moments, by, F.max("_n").alias("n"), packed.alias("_s")).select(
        *by, "n", F.array(*[F.get("_s._mean", F.lit(i)) for i in ends]).alias("mean"), F.col("_s._cov").alias("cov"))


def solved(df: DataFrame, by, terms, y: str) -> DataFrame:
    """The solution ``s`` per group."""
    constant = terms.index(INTERCEPT) if INTERCEPT in terms else None
    return packed_moments(df, by, terms, y).select(*by, nx.solver(constant)("n", "mean", "cov").alias("s"))


def centred(terms) -> list[Column]:
    """The terms less their means; the intercept stays."""
    return [F.col(t) - F.element_at("means", i + 1) for i, t in enumerate(terms)]


def join_groups(rows: DataFrame, groups: DataFrame, by) -> DataFrame:
    """Rows beside their group's single row."""
    if by:
        return rows.join(groups, list(by))
    # Ungrouped fits have one row, read as a scalar subquery; without it no row is left.
    one = groups.select(F.struct(*groups.columns).alias("_g")).scalar()
    return rows.withColumn("_g", one).where(F.col("_g").isNotNull()).select(*rows.columns, "_g.*")


def design(df: DataFrame, terms) -> DataFrame:
    """Adds the intercept column when a term asks for it."""
    return df.withColumn(INTERCEPT, F.lit(1.0)) if INTERCEPT in terms and INTERCEPT not in df.columns else df


def ols(df: DataFrame, y: str, terms, by=(), order: str = "date", blocked: bool | None = None) -> Fit:
    """OLS per group.

    ``blocked`` says whether tests of the fit take lags in blocks of a series
    or in one window per group; by default a fit without groups takes blocks.

    A group that is rank-deficient or saturated, or holds a null or non-finite
    value, has null ``beta`` and no rows.
    """
    terms, by = tuple(terms), tuple(by)
    if len(set(terms)) != len(terms):
        raise ValueError("Regression term names must be unique")
    k = len(terms)
    # Places of another fit's rows may have gaps here.
    base = design(df, terms).drop(PLACE)
    solution = solved(base, by, terms, y)
    enough = F.col("s.n") > k
    groups = solution.select(
        *by, F.col("s.n").alias("n"), (F.col("s.n") - k).alias("df"),
        *[F.when(enough, F.col(f"s.{c}")).alias(c) for c in ("beta", "inverse", "means", "gamma", "core")],
        F.col("s.rank").alias("rank"), F.col("s.condition").alias("condition"),
    )
    slim = groups.where("beta is not null").select(*by, "beta", "means", "gamma", "core", "df")
    rows = join_groups(base, slim, by)
    fitted = sum((z * F.element_at("gamma", i + 1) for i, z in enumerate(centred(terms))), F.lit(0.0))
    rows = rows.withColumn("fitted", fitted).withColumn("resid", F.col(y) - F.col("fitted"))
    return Fit(groups, rows, y, terms, by, order, not by if blocked is None else blocked)


def hac(fit: Fit, max_lag: int) -> DataFrame:
    """Newey-West errors, t statistics, p-values and 95% limits per term.

    Bartlett weights and the n/(n-k) correction.  The weighted lagged scores
    are summed per row first, so the aggregation holds k*k sums whatever the
    number of lags.
    """
    scores = F.array(*[z * F.col("resid") for z in centred(fit.terms)])
    place = [PLACE] if PLACE in fit.rows.columns else []
    rows = fit.rows.select(*fit.by, fit.order, *place, scores.alias("_g"))
    if max_lag:
        rows = fit.lagged(rows, {f"_l{i}": ("_g", i) for i in range(1, max_lag + 1)})

    def weighted(v: Column, i: Column) -> Column:
        total = v * 0.5
        for lag in range(1, max_lag + 1):
            total = total + F.coalesce(F.get(f"_l{lag}", i), F.lit(0.0)) * (1.0 - lag / (max_lag + 1.0))
        return total

    rows = rows.withColumn("_h", F.transform("_g", weighted))
    k = len(fit.terms)
    flat = rows.select(
        *fit.by, *[F.col("_g")[i].alias(f"_g{i}") for i in range(k)],
        *[F.col("_h")[i].alias(f"_h{i}") for i in range(k)],
    )
    sums = summed_products(
        flat, fit.by, [f"_g{i}" for i in range(k)], [f"_h{i}" for i in range(k)], "half"
    )
    table = join_groups(fit.groups.where("beta is not null"), sums, fit.by)
    constant = fit.terms.index(INTERCEPT) if INTERCEPT in fit.terms else None
    errors = nx.sandwich_errors(constant)(F.struct("core", "means", "half", ratio("n", "df").alias("factor")))
    names = F.array(*[F.lit(t) for t in fit.terms])
    long = table.withColumn("_se", errors).select(
        *fit.by, "n", "df", F.inline(F.arrays_zip(names.alias("term"), F.col("beta").alias("coef"), F.col("_se").alias("se")))
    )
    out = long.withColumn("t", ratio("coef", "se"))
    out = out.withColumn("p_value", nx.t_p_value("t", F.col("df").cast("double")))
    out = out.withColumn("_q", nx.t_quantile(F.col("df").cast("double")))
    return out.withColumn("ci_low", F.col("coef") - F.col("_q") * F.col("se")).withColumn(
        "ci_high", F.col("coef") + F.col("_q") * F.col("se")
    ).drop("_q")


def cooks(fit: Fit) -> DataFrame:
    """Rows with leverage and Cook's distance."""
    k = len(fit.terms)

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)

    x = F.array(*centred(fit.terms))
    leverage = total(F.transform(x, lambda a, i: a * total(
        F.zip_with(F.slice("core", i * k + 1, k), x, lambda p, b: p * b)
    )))
    residual_ss = F.sum(F.col("resid") * F.col("resid"))
    variance = grouped(fit.rows, fit.by, residual_ss.alias("_ss"))
    rows = join_groups(fit.rows, variance, fit.by).withColumn("leverage", leverage)
    s2 = ratio("_ss", "df")
    free = 1.0 - F.col("leverage")
    distance = ratio(
        F.col("resid") * F.col("resid") * F.col("leverage"), s2 * k * free * free
    )
    return rows.withColumn("cooks", distance).drop("_ss")


def max_cooks(fit: Fit) -> DataFrame:
    return grouped(cooks(fit), fit.by, F.max("cooks").alias("max_cooks"))


def design_rank(df: DataFrame, terms, by=()) -> DataFrame:
    """Rank of the design against its column count."""
    terms = tuple(terms)
    ranked = solved(design(df, terms), by, terms, terms[0]).select(*by, F.col("s.rank").alias("rank"))
    return ranked.select(*by, "rank", F.lit(len(terms)).alias("columns"),
                         (F.col("rank") == len(terms)).alias("full_rank"))


def condition_number(df: DataFrame, terms, by=()) -> DataFrame:
    """Condition number of the standardised design (population deviation)."""
    terms = (INTERCEPT, *[t for t in terms if t != INTERCEPT])
    return solved(design(df, terms), by, terms, terms[0]).select(*by, F.col("s.condition").alias("condition"))


def breusch_godfrey(fit: Fit, lags: int) -> DataFrame:
    """LM test of residual autocorrelation at ``lags`` lags.

    Lags reaching before the sample count as zero; LM = n * R-squared of the
    residual on the design and its lags.
    """
    names = [f"_lag{i}" for i in range(1, lags + 1)]
    lagged = fit.lagged(fit.rows, {name: ("resid", i) for i, name in enumerate(names, 1)})
    base = lagged.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in names}).select(*fit.by, fit.order, *fit.terms, "resid", *names)
    aux = ols(base.withColumnRenamed("resid", "_u"), "_u", (*fit.terms, *names), fit.by, fit.order)
    stats = grouped(
        aux.rows, fit.by, F.count(F.lit(1)).alias("n"),
        F.sum(F.col("resid") * F.col("resid")).alias("ss"),
        (F.var_pop("_u") * F.count(F.lit(1))).alias("total"),
    )
    lm = F.col("n") * (1.0 - ratio("ss", "total"))
    return stats.select(*fit.by, lm.alias("lm")).withColumn(
        "bg_p_value", nx.chi2_p_value("lm", F.lit(float(lags)))
    )


def default_adf_lag(n: Column) -> Column:
    """Schwert's rule, bounded by half the sample."""
    return F.greatest(F.lit(0), F.least(F.floor(n / 2) - 1, F.ceil(F.pow(n / 100.0, F.lit(0.25)) * 12.0))).cast("int")


def adf(rows: DataFrame, value: str = "resid", by=(), order: str = "date",
        max_lag: int | None = None, blocked: bool | None = None) -> DataFrame:
    """Augmented Dickey-Fuller without a deterministic term, lag by AIC.

    One Gram matrix over the common sample holds every candidate regression as
    a leading block; the chosen lag is then refitted on its own longer sample.
    ``max_lag`` defaults to Schwert's rule on each group's own size; the one
    action asks for the widest, which sets the number of columns.  Every group
    has a row; one too short for the test has nulls.  ``blocked``: see ``ols``.
    """
    by = tuple(by)
    blocked = not by if blocked is None else blocked
    cap = default_adf_lag(F.col("_n")) if max_lag is None else F.lit(max_lag)
    groups = grouped(rows, by, F.count(F.lit(1)).alias("_n")).select(*by, cap.alias("_cap"))
    widest = max_lag if max_lag is not None else groups.agg(F.max("_cap")).first()[0] or 0
    lags = {f"_u{i}": ("_u", i) for i in range(1, widest + 2)}
    staged = lag_columns(rows.select(*by, order, col(value).alias("_u")), by, order, lags, blocked)
    if PLACE not in staged.columns:
        staged = staged.withColumn(PLACE, F.row_number().over(W.partitionBy(*by).orderBy(order)))
    lag_names = [f"_d{i}" for i in range(1, widest + 1)]
    staged = join_groups(staged, groups, by).select(
        *by, order, "_cap", F.col(PLACE).alias("_pos"), F.col("_u1").alias("_lvl"), (F.col("_u") - F.col("_u1")).alias("_d"),
        *[F.when(F.col("_cap") >= i, F.col(f"_u{i}") - F.col(f"_u{i + 1}")).otherwise(0.0).alias(name)
          for i, name in enumerate(lag_names, 1)],
    )
    terms = ("_lvl", *lag_names)
    common = staged.where(F.col("_pos") > F.col("_cap") + 1)
    chosen = join_groups(packed_gram(common, by, terms, "_d"), groups, by).select(
        *by, _aic_lag("packed", "_cap").alias("lag"))
    # Refit: unused lags become zero and only rows with all used lags stay.
    refit = join_groups(staged, chosen, by).where(F.col("_pos") > F.col("lag") + 1)
    refit = refit.withColumns({
        name: F.when(F.col("lag") >= i, F.col(name)).otherwise(F.lit(0.0))
        for i, name in enumerate(lag_names, 1)
    }) if lag_names else refit
    final = join_groups(packed_gram(refit, by, terms, "_d"), chosen, by)
    out = final.select(*by, "lag", _tau("packed", F.col("lag").cast("double")).alias("tau"))
    out = groups.select(*by).join(out, list(by), "left") if by else out
    return out.withColumn("adf_p_value", nx.dickey_fuller_p_value("tau"))


def _leading_fit(full, size: int):
    """Coefficients, inverse and residual sum of squares of the first terms."""
    block, head = full[1:size + 1, 1:size + 1], full[1:size + 1, -1]
    if full[0, 0] <= size or gram_rank(block) < size:
        return None
    beta, inverse = solve_scaled(block, head)
    return beta, inverse, float(full[-1, -1] - 2.0 * beta @ head + beta @ block @ beta)


@F.pandas_udf(T.IntegerType())
def _aic_lag(packed: pd.Series, cap: pd.Series) -> pd.Series:
    def best(full, most):
        scores, n = [], full[0, 0]
        for size in range(1, most + 2):
            fit = _leading_fit(full, size)
            if fit is not None and fit[2] > 0:
                scores.append((n * math.log(fit[2] / n) + 2.0 * size, size - 1))
        return min(scores)[1] if scores else 0

    return pd.Series([best(unpack(p), int(most)) for p, most in zip(packed, cap)], dtype="int32")


@F.pandas_udf(T.DoubleType())
def _tau(packed: pd.Series, lag: pd.Series) -> pd.Series:
    def statistic(full, used):
        size = int(used) + 1
        fit = _leading_fit(full, size)
        if fit is None or fit[2] <= 0:
            return None
        beta, inverse, ss = fit
        return float(beta[0] / math.sqrt(inverse[0, 0] * ss / (full[0, 0] - size)))

    return pd.Series([statistic(unpack(p), u) for p, u in zip(packed, lag)], dtype="float64")


def adf_gate(table: DataFrame, level: float = 0.10) -> DataFrame:
    """Residuals pass as stationary when the p-value is below the level."""
    return table.withColumn(
        "stationary", F.coalesce(F.col("adf_p_value") < level, F.lit(False))
    )


# --- design columns ----------------------------------------------------------

def month_index(date) -> Column:
    return (F.year(col(date)) * 12 + F.month(col(date))).cast("int")


def with_trend(df: DataFrame, unit: Column, out: str, by=()) -> DataFrame:
    """Adds the zero-based trend from the first row of the group."""
    by = tuple(by)
    staged = df.withColumn("_unit", unit)
    first = grouped(staged, by, F.min("_unit").alias("_first"))
    return join_groups(staged, first, by).withColumn(out, (F.col("_unit") - F.col("_first")).cast("double")).drop("_unit", "_first")


MONTH_TERMS = tuple(f"month_{m:02d}" for m in range(2, 13))


def segmented_design(df: DataFrame, break_date, by=(), date: str = "date") -> DataFrame:
    """Monthly trend, month dummies, level shift and slope after a break."""
    idx = month_index(date)
    cut = month_index(F.lit(break_date).cast("date"))
    return with_trend(df, idx, "monthly_trend", by).withColumns({
        **{name: F.when(F.month(col(date)) == m, 1.0).otherwise(0.0)
           for m, name in zip(range(2, 13), MONTH_TERMS)},
        "level_shift": F.when(idx >= cut, 1.0).otherwise(0.0),
        "slope_shift": F.greatest(F.lit(0), idx - cut).cast("double"),
    })


SEGMENTED_TERMS = (INTERCEPT, "monthly_trend", *MONTH_TERMS, "level_shift", "slope_shift")


def exceptional_dates(df: DataFrame, dates, out: str = "exceptional", date: str = "date") -> DataFrame:
    """Indicator of a registered set of dates."""
    hit = col(date).isin([F.lit(d).cast("date") for d in dates])
    return df.withColumn(out, F.when(hit, 1.0).otherwise(0.0))


def drop_ends(df: DataFrame, n: int = 12, by=(), order: str = "date", blocked: bool | None = None) -> DataFrame:
    """Two variants of a sample: without its first n and without its last n rows.

    ``blocked``: see ``ols``.
    """
    by = tuple(by)
    blocked = not by if blocked is None else blocked
    df = df.drop(PLACE)
    numbered = placed(df, by, order) if blocked else df.withColumn(PLACE, F.row_number().over(W.partitionBy(*by).orderBy(order)))
    sizes = grouped(df, by, F.count(F.lit(1)).alias("_size"))
    staged = join_groups(numbered.withColumnRenamed(PLACE, "_pos"), sizes, by)
    kinds = F.array(
        F.when(F.col("_pos") > n, F.lit("without_first")),
        F.when(F.col("_pos") <= F.col("_size") - n, F.lit("without_last")),
    )
    return staged.withColumn("variant", F.explode(kinds)).where("variant is not null").drop("_pos", "_size")


def direction_matches(value, expected: str) -> Column:
    v = col(value)
    return {"positive": v > 0, "negative": v < 0}.get(expected, v != 0)


def stability_gate(df: DataFrame, y: str, terms, focal: str, expected: str, n: int = 12,
                   min_rows: int = 36, by=(), order: str = "date", rebuild=None,
                   blocked: bool | None = None) -> DataFrame:
    """Does the focal sign persist without the first and the last rows?

    ``rebuild`` recomputes design columns that depend on the sample start.
    ``blocked``: see ``ols``.
    """
    by = tuple(by)
    parts = drop_ends(df, n, by, order, blocked)
    keys = (*by, "variant")
    if rebuild is not None:
        parts = rebuild(parts, keys)
    fit = ols(parts, y, terms, keys, order)
    position = tuple(terms).index(focal) + 1
    signed = fit.groups.select(
        *by, F.coalesce(direction_matches(F.element_at("beta", position), expected), F.lit(False)).alias("ok")
    )
    agree = grouped(signed, by, F.min("ok").alias("_ok"), F.count(F.lit(1)).alias("_fits"))
    sizes = grouped(df, by, F.count(F.lit(1)).alias("n"))
    joined = join_groups(sizes, agree, by)
    passed = (F.col("n") > min_rows) & (F.col("_fits") == 2) & F.col("_ok")
    return joined.select(*by, "n", passed.alias("stable"))
