"""Collects queries and their SQL counterparts under one key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.fixtures import with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, fixtures: str = "", sql: str | None = None):
    """Register a query; without ``sql`` it is checked by the tests instead."""
    def add(fn):
        if key in QUERIES:
            raise ValueError(f"Query registered twice: {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = with_sql(fixtures, sql)
        return fn
    return add


def rd(expr: str, digits: int = 6) -> str:
    """SQL: rounded, positive zero, null instead of NaN or infinity."""
    return f"(CASE WHEN isfinite({expr}) THEN round({expr}, {digits}) + 0.0 END)"


def r(value: str | Column, digits: int = 6, name: str | None = None) -> Column:
    c = F.col(value) if isinstance(value, str) else value
    out = F.round(c, digits) + F.lit(0.0)
    alias = name or (value if isinstance(value, str) else None)
    return out.alias(alias) if alias else out


def corr_sql(x: str, y: str, over: str = "") -> str:
    """SQL: correlation that is null on a constant side."""
    o = f" over {over}" if over else ""
    return (f"(covar_samp({x},{y}){o} / nullif(stddev_samp(CASE WHEN {y} IS NOT NULL THEN {x} END){o}"
            f" * stddev_samp(CASE WHEN {x} IS NOT NULL THEN {y} END){o}, 0))")
