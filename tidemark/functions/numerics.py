"""Distribution tails and k-by-k solves for regression.

Spark aggregates the design's cross products; what arrives here is one small
k-by-k system per fit, so these run as Arrow-batched column functions whose
input never grows with the number of observations.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# MacKinnon (1994) response surface for the Dickey-Fuller tau
# statistic with no deterministic term and one variable.
TAU_SMALL = (0.6344, 1.2378, 0.032496)
TAU_LARGE = (0.4797, 0.93557, -0.06999, 0.033066)
TAU_SWITCH = -1.04
TAU_MINIMUM = -19.04


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz continued fraction of the incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return value


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t."""
    return beta_regularised(df / 2.0, 0.5, df / (df + t * t))


def t_critical(df: float, level: float = 0.95) -> float:
    """The two-sided critical value, by bisection on the tail."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1.0 - level:
        high *= 2.0
    for _ in range(200):
        middle = 0.5 * (low + high)
        if middle in (low, high):
            break
        if t_two_sided(middle, df) > 1.0 - level:
            low = middle
        else:
            high = middle
    return 0.5 * (low + high)


def chi2_tail(x: float, df: float) -> float:
    """P(chi-square > x): series below the mean, continued fraction above."""
    a, x = df / 2.0, x / 2.0
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - front * total
    tiny, b = 1e-300, x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    value = d
    for i in range(1, 1000):
        numerator = -i * (i - a)
        b += 2.0
        d = numerator * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + numerator / c
        c = c if abs(c) > tiny else tiny
        value *= c * d
        if abs(c * d - 1.0) < 1e-16:
            break
    return front * value


def tau_p_value(tau: float) -> float:
    """Approximate p-value of the Dickey-Fuller statistic without a constant."""
    if tau < TAU_MINIMUM:
        return 0.0
    weights = TAU_SMALL if tau <= TAU_SWITCH else TAU_LARGE
    return normal_cdf(sum(w * tau**i for i, w in enumerate(weights)))


def solve_scaled(gram: np.ndarray, moment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and inverse Gram, with columns scaled to unit length."""
    scale = 1.0 / np.sqrt(np.diag(gram))
    inverse = np.linalg.inv(gram * np.outer(scale, scale)) * np.outer(scale, scale)
    beta = inverse @ moment
    return beta + inverse @ (moment - gram @ beta), inverse


def gram_rank(gram: np.ndarray, tolerance: float = 1e-12) -> int:
    """Rank of the design from its unit-scaled Gram matrix."""
    diagonal = np.diag(gram)
    scale = np.where(diagonal > 0, 1.0 / np.sqrt(np.where(diagonal > 0, diagonal, 1.0)), 0.0)
    return int((np.linalg.eigvalsh(gram * np.outer(scale, scale)) > tolerance).sum())


SOLUTION = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("beta", T.ArrayType(T.DoubleType())),
    T.StructField("inverse", T.ArrayType(T.DoubleType())),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("gamma", T.ArrayType(T.DoubleType())),
    T.StructField("core", T.ArrayType(T.DoubleType())),
    T.StructField("rank", T.IntegerType()),
    T.StructField("condition", T.DoubleType()),
])


def unpack(packed: np.ndarray) -> np.ndarray:
    """Symmetric matrix from its row-wise upper triangle."""
    m = int((math.sqrt(8 * len(packed) + 1) - 1) / 2)
    full = np.zeros((m, m))
    full[np.triu_indices(m)] = packed
    return full + np.triu(full, 1).T


def constant_columns(cov: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Columns without spread, up to the rounding of merged means."""
    return np.sqrt(np.maximum(np.diag(cov), 0.0)) <= 1e-12 * np.abs(mean)


def _centred_solution(n: int, mean: np.ndarray, cov: np.ndarray, constant: int) -> tuple:
    """Fit with an intercept, solved on columns less their means.

    ``mean`` and ``cov`` hold the other terms, then the dependent.
    """
    x, m, y = cov[:-1, :-1], mean[:-1], mean[-1]
    still = constant_columns(x, m)
    moving = x[np.ix_(~still, ~still)]
    rank = 1 + (gram_rank(moving) if len(moving) else 0)
    if rank <= len(m):
        return None, None, None, None, None, rank, None
    slope, inverse = solve_scaled(x, cov[:-1, -1]) if len(m) else (np.zeros(0), np.zeros((0, 0)))
    inverse = inverse / n
    spread = np.sqrt(np.diag(x))
    values = np.append(np.linalg.eigvalsh(x / np.outer(spread, spread)), 1.0)
    at = np.delete(np.arange(len(m) + 1), constant)
    core, full = np.zeros((2, len(m) + 1, len(m) + 1))
    core[constant, constant], core[np.ix_(at, at)] = 1.0 / n, inverse
    full[np.ix_(at, at)] = inverse
    full[constant, at] = full[at, constant] = -inverse @ m
    full[constant, constant] = 1.0 / n + m @ inverse @ m
    gamma, means = np.insert(slope, constant, y), np.insert(m, constant, 0.0)
    beta = np.insert(slope, constant, y - slope @ m)
    condition = math.sqrt(values.max() / values.min()) if values.min() > 0 else None
    return beta, full, means, gamma, core, rank, condition


def _plain_solution(n: int, mean: np.ndarray, cov: np.ndarray) -> tuple:
    """Fit without an intercept, on the columns as they are."""
    full = n * (cov + np.outer(mean, mean))
    gram, moment = full[:-1, :-1], full[:-1, -1]
    rank = gram_rank(gram)
    if rank < len(moment):
        return None, None, None, None, None, rank, None
    beta, inverse = solve_scaled(gram, moment)
    return beta, inverse, np.zeros(len(moment)), beta, inverse, rank, None


def solver(constant: int | None = None):
    """Column function: counts, means and packed covariances of (terms..., y) -> solution.

    ``constant`` is the position of the intercept among the terms; it is not
    among the columns.  With it the system is centred, so columns whose mean
    is large beside their spread lose no digits.  ``means``, ``gamma`` and
    ``core`` are the fit in centred columns: fitted values are
    ``gamma . (x - means)`` and ``core`` is the inverse cross product there.
    Without an intercept they equal the plain fit.  A singular or non-finite
    system gives null coefficients and its rank.
    """

    @F.pandas_udf(SOLUTION)
    def solve(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for sizes, means, covs in batches:
            rows = []
            for n, mean, cov in zip(sizes, means, covs):
                mean, cov = np.array(mean, dtype=float), unpack(np.array(cov, dtype=float))
                if not n or not (np.isfinite(mean).all() and np.isfinite(cov).all()):
                    rows.append((None, None, None, None, None, None, 0, None))
                    continue
                solution = _plain_solution(n, mean, cov) if constant is None else _centred_solution(n, mean, cov, constant)
                rows.append((int(n), *[v.reshape(-1).tolist() if isinstance(v, np.ndarray) else v for v in solution]))
            yield pd.DataFrame(rows, columns=SOLUTION.names)

    return solve


def sandwich_errors(constant: int | None):
    """Column function of a struct ``core, means, half, factor`` -> standard errors.

    Inverse and score sums are those of centred columns; ``half`` is one half of
    the score sums.  Only the intercept's error needs the means: its column is
    the centred one less the means' share.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def errors(fits: pd.DataFrame) -> pd.Series:
        out = []
        for flat, mean, meat, f in zip(fits["core"], fits["means"], fits["half"], fits["factor"]):
            k = int(math.sqrt(len(flat)))
            a, m = np.array(flat, dtype=float).reshape(k, k), np.array(meat, dtype=float).reshape(k, k)
            covariance = a @ (m + m.T) @ a
            variance = np.diag(covariance).copy()
            if constant is not None:
                back = -np.array(mean, dtype=float)
                back[constant] = 1.0
                variance[constant] = back @ covariance @ back
            out.append(np.sqrt(np.maximum(variance * f, 0.0)).tolist())
        return pd.Series(out)

    return errors


@F.pandas_udf(T.DoubleType())
def t_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        t_two_sided(t, d) if pd.notna(t) and pd.notna(d) and d > 0 else None
        for t, d in zip(statistic, df)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_quantile(df: pd.Series) -> pd.Series:
    known = {d: t_critical(d) for d in df.dropna().unique() if d > 0}
    return df.map(known).astype("float64")


@F.pandas_udf(T.DoubleType())
def chi2_p_value(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([
        chi2_tail(x, d) if pd.notna(x) and pd.notna(d) else None
        for x, d in zip(statistic, df)
    ], dtype="float64")


@F.pandas_udf(T.DoubleType())
def dickey_fuller_p_value(tau: pd.Series) -> pd.Series:
    return pd.Series([tau_p_value(t) if pd.notna(t) else None for t in tau], dtype="float64")
