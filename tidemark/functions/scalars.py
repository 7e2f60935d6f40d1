"""Scalar column functions; all stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import STATUSES

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Cell texts that mean "no value".
BLANK_CELLS = ("", "-", "—", "..", "…")


def col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(num, den) -> Column:
    """Division that is null on a zero or missing denominator."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num, den) -> Column:
    return ratio(num, den) * 100.0


def change(value, previous) -> Column:
    """Relative change, null when either side is missing or the base is zero."""
    return ratio(value, previous) - 1.0


def finite(value) -> Column:
    """Null instead of NaN and the infinities."""
    c = col(value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def clean_double(value, digits: int | None = 4, *, text: bool = False) -> Column:
    """A finite, rounded double; anything that is not a number becomes null.

    ``text=True`` admits only plain decimal notation, so that suffixes Java
    would accept ("1.5d") stay non-numeric.
    """
    c = col(value)
    if text:
        c = F.when(c.rlike(NUMBER), F.trim(c)).try_cast("double")
    c = finite(c)
    return c if digits is None else F.round(c, digits)


def parse_number(value) -> Column:
    """Number in a published cell: thousands commas, dashes, (negatives)."""
    c = F.trim(F.replace(col(value), F.lit(","), F.lit("")))
    inner = F.regexp_extract(c, r"^\((.*)\)$", 1)
    bracketed = c.rlike(r"^\(.*\)$")
    number = clean_double(F.when(bracketed, inner).otherwise(c), None, text=True)
    return F.when(c.isin(*BLANK_CELLS), None).otherwise(
        F.when(bracketed, -number).otherwise(number)
    )


def negate(value) -> Column:
    """Deficit to balance; a zero stays a positive zero."""
    return F.lit(0.0) - col(value)


def per_capita(volume, population, scale: float = 1.0) -> Column:
    p = col(population)
    return F.when(p > 0, ratio(col(volume) * scale, p))


def average_ticket(value, volume, value_scale: float = 1.0, volume_scale: float = 1.0) -> Column:
    v = col(volume)
    return F.when(v > 0, ratio(col(value) * value_scale, v * volume_scale))


def norm_label(value) -> Column:
    """Drop a leading ordinal ("3. "), trim and lower-case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(col(value)), r"^\d+\.\s*", "")))


def lookup(value, mapping: dict[str, str]) -> Column:
    """Small fixed mapping as a CASE; unknown keys give null."""
    c = col(value)
    branches = [(c == k, F.lit(v)) for k, v in mapping.items()]
    first, *rest = branches
    return reduce(lambda acc, b: acc.when(*b), rest, F.when(*first))


def map_category(value, mapping: dict[str, str]) -> Column:
    """Category normaliser on upper-cased, trimmed text; unknown gives null."""
    return lookup(F.upper(F.trim(col(value))), {k.upper(): v for k, v in mapping.items()})


def status_rank(status) -> Column:
    return lookup(status, {s: str(i) for i, s in enumerate(STATUSES)}).cast("int")


def status_of_rank(rank) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATUSES]), col(rank) + 1)


def least_final(*statuses) -> Column:
    """The least settled of several statuses."""
    ranks = [status_rank(s) for s in statuses]
    return status_of_rank(ranks[0] if len(ranks) == 1 else F.greatest(*ranks))


def status_from_year(year, rules: dict[int, str], default: str = "actual") -> Column:
    """Status by the highest cut-off year reached."""
    y = col(year)
    ordered = sorted(rules.items(), reverse=True)
    first, *rest = [(y >= cut, F.lit(s)) for cut, s in ordered]
    return reduce(lambda acc, b: acc.when(*b), rest, F.when(*first)).otherwise(F.lit(default))


def status_from_suffix(label) -> Column:
    """Status from a bracket suffix: none or (A), (RE), (BE)."""
    suffix = F.regexp_extract(col(label), r"\((A|RE|BE)\)\s*$", 1)
    return (
        F.when(suffix.isin("", "A"), F.lit("actual"))
        .when(suffix == "RE", F.lit("revised"))
        .when(suffix == "BE", F.lit("budget"))
    )


def effect(coefficient, kind: str) -> Column:
    """Fitted coefficient on its reporting scale."""
    b = col(coefficient)
    if kind == "identity":
        return b
    if kind == "annual_log_percent":
        return F.expm1(b * 12.0) * 100.0
    if kind == "annual_level":
        return b * 12.0
    if kind == "log_percent":
        return F.expm1(b) * 100.0
    raise ValueError(f"Unknown effect scale: {kind}")


def effect_error(coefficient, error, kind: str) -> Column:
    """Delta-method standard error on the reporting scale of ``effect``."""
    b, se = col(coefficient), col(error)
    if kind == "identity":
        return se
    if kind == "annual_log_percent":
        return F.abs(F.exp(b * 12.0) * se * 1200.0)
    if kind == "annual_level":
        return se * 12.0
    if kind == "log_percent":
        return F.abs(F.exp(b) * se * 100.0)
    raise ValueError(f"Unknown effect scale: {kind}")


def offset_ratio(inflow, outflow) -> Column:
    """max(inflow, 0) / |outflow| while the outflow is negative, else null."""
    i, o = col(inflow), col(outflow)
    return F.when(o < 0, ratio(F.greatest(i, F.lit(0.0)), F.abs(o)))


def predict_debt(previous, balance, interest_pct: float, growth_pct: float) -> Column:
    """One-step debt recursion: prev * (1 + i) / (1 + g) - balance."""
    return col(previous) * (1.0 + interest_pct / 100.0) / (1.0 + growth_pct / 100.0) - col(balance)
