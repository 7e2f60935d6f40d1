"""Fiscal years (1 April - 31 March), quarters, months and period indexes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.scalars import col, lookup

# English month names, fixed.
MONTH_NAMES = (
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
)


def fy_end(date) -> Column:
    """Calendar year in which the fiscal year of a date ends."""
    return F.year(F.add_months(col(date), 9)).cast("int")


def fy_start(date) -> Column:
    return (fy_end(date) - 1).cast("int")


def fy_label(start_year) -> Column:
    """FY2024-25 for start year 2024."""
    y = col(start_year)
    return F.format_string("FY%d-%02d", y.cast("int"), ((y + 1) % 100).cast("int"))


def fy_start_date(start_year) -> Column:
    return F.make_date(col(start_year), F.lit(4), F.lit(1))


def fy_end_date(start_year) -> Column:
    return F.make_date(col(start_year) + 1, F.lit(3), F.lit(31))


def fiscal_quarter_start(start_year, quarter) -> Column:
    """First day of fiscal quarter 1..4; any other quarter is an error."""
    q = col(quarter).cast("int")
    return F.when(
        q.between(1, 4), F.add_months(fy_start_date(start_year), (q - 1) * 3)
    ).otherwise(
        F.raise_error(F.format_string("Quarter must be between 1 and 4; received %s", q.cast("string"))).cast("date")
    )


def fiscal_quarter_end(start_year, quarter) -> Column:
    return F.last_day(F.add_months(fiscal_quarter_start(start_year, quarter), 2))


def month_end(year, month) -> Column:
    return F.last_day(F.make_date(col(year), col(month), F.lit(1)))


def quarter_end(year, quarter) -> Column:
    return F.last_day(F.make_date(col(year), col(quarter) * 3, F.lit(1)))


def period_index(date, frequency: str) -> Column:
    """Consecutive integer per period of the frequency."""
    d = col(date)
    if frequency == "monthly":
        return (F.year(d) * 12 + F.month(d)).cast("int")
    if frequency == "quarterly":
        return (F.year(d) * 4 + F.quarter(d)).cast("int")
    if frequency in ("annual", "fiscal_year", "academic_year"):
        return F.year(d).cast("int")
    raise ValueError(f"Unsupported period frequency: {frequency}")


def _month_number(name: Column) -> Column:
    full = {n: str(i) for i, n in enumerate(MONTH_NAMES, 1)}
    short = {n[:3]: v for n, v in full.items()}
    return lookup(F.lower(name), full | short | {"sept": "9"}).cast("int")


def parse_month(value) -> Column:
    """Month end from text such as "April 2024", "Apr-24" or "Sep – 2023"."""
    text = F.regexp_replace(F.trim(col(value)), "[–—]", "-")
    pattern = r"([A-Za-z]{3,9})[-\s]+(\d{4}|\d{2})"
    month = _month_number(F.regexp_extract(text, pattern, 1))
    year = F.regexp_extract(text, pattern, 2).try_cast("int")
    return month_end(F.when(year < 100, year + 2000).otherwise(year), month)


def parse_quarter_label(value) -> Column:
    """Quarter end from "April-June 2024"; anything else gives null."""
    text = col(value)
    pattern = r"^\s*([A-Za-z]+)-[A-Za-z]+ (\d{4})\s*$"
    first = _month_number(F.regexp_extract(text, pattern, 1))
    year = F.regexp_extract(text, pattern, 2).try_cast("int")
    return F.when(first.isin(1, 4, 7, 10), month_end(year, first + 2))
