"""Records, documents, wide and long shapes, latest rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.scalars import col
from tidemark.schema import STALE_AFTER_DAYS, STALE_AFTER_DEFAULT


def derive_indicator(df: DataFrame, name: str, value: Column, *, unit: str | None = None,
                     method: str | None = None, **replace: Column) -> DataFrame:
    """A new indicator row per input row, other fields carried over."""
    changes = {"indicator": F.lit(name), "value": value, "is_derived": F.lit(True), **replace}
    if unit is not None:
        changes["unit"] = F.lit(unit)
    if method is not None:
        changes["method"] = F.lit(method)
    return df.withColumns(changes)


def with_definitions(df: DataFrame, definitions: DataFrame, key: str = "indicator") -> DataFrame:
    """Attach label, unit and methodology of the series."""
    return df.join(definitions, key, "left")


def source_rows(df: DataFrame) -> DataFrame:
    """Provenance rows as JSON, absent fields left out."""
    return df.select(F.to_json(F.struct("name", "url", "retrieved_at")).alias("source"))


def union_records(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def key_diff(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side that has them."""
    e, g = expected.select(key).distinct(), got.select(key).distinct()
    return e.join(g, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(
        g.join(e, key, "left_anti").withColumn("side", F.lit("unexpected"))
    )


def distinct_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with their first appearance, in that order."""
    first = df.groupBy(key).agg(F.min(order).alias("first_seen"))
    return first.orderBy("first_seen", key)


def outer_align(frames: dict[str, DataFrame], on="date") -> DataFrame:
    """Full outer alignment of several series as one wide frame; ``on`` may be several columns.

    The series are stacked and pivoted: one exchange instead of one per join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    stacked = union_records(*[
        f.select(*keys, F.lit(k).alias("_series"), "value") for k, f in frames.items()
    ])
    return stacked.groupBy(*keys).pivot("_series", list(frames)).agg(F.first("value"))


def to_wide(df: DataFrame, keys, on: str = "date", key: str = "indicator", value: str = "value") -> DataFrame:
    """Long to wide; the keys are given, so no extra pass finds them."""
    return df.groupBy(on).pivot(key, list(keys)).agg(F.first(col(value), ignorenulls=True))


def to_long(wide: DataFrame, ids, columns, key: str = "series", value: str = "value") -> DataFrame:
    return wide.unpivot(list(ids), list(columns), key, value)


def densify_years(df: DataFrame, start: int, end: int, keys=("entity",), year: str = "year") -> DataFrame:
    """Every year of the range per key; absent years carry null."""
    spine = df.select(*keys).distinct().withColumn(
        year, F.explode(F.sequence(F.lit(start), F.lit(end)))
    )
    return spine.join(df, [*keys, year], "left")


def canonical_order(df: DataFrame) -> DataFrame:
    return df.orderBy("date", "indicator", "entity")


def series_documents(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """One row per defined series with its ordered values.

    Values are sorted inside the series; a definition without records keeps an
    empty list.  A series is bounded by the calendar.
    """
    point = F.struct("date", "value", "status", "period_label")
    nested = records.groupBy(F.col("indicator").alias("key")).agg(
        F.sort_array(F.collect_list(point)).alias("values")
    )
    empty = F.array().cast("array<struct<date:date,value:double,status:string,period_label:string>>")
    return definitions.join(nested, "key", "left").withColumn(
        "values", F.coalesce("values", empty)
    )


def to_dated_multi_series(records: DataFrame, definitions: DataFrame, metadata: dict[str, str], by=()) -> DataFrame:
    """The dated multi-series document as JSON, one row for each group of ``by``.

    ``definitions(ordinal, key, label, entity, unit, is_derived)``.  The
    document is the unit of publication: its size is the number of registered
    series times the calendar.  Every document lists every defined series.
    """
    point = F.struct("date", "value", "status", "period_label")
    nested = records.groupBy(*by, F.col("indicator").alias("key")).agg(F.sort_array(F.collect_list(point)).alias("values"))
    found = nested.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("m"))
    registered = definitions.agg(F.sort_array(F.collect_list(
        F.struct("ordinal", "key", "label", "entity", "unit", "is_derived")))).scalar()
    nothing = F.array().cast("array<struct<date:date,value:double,status:string,period_label:string>>")

    def entry(e):
        held = F.coalesce(F.try_element_at("m", e["key"]), nothing).alias("values")
        return F.struct(e["ordinal"].alias("ordinal"), e["key"].alias("key"), F.struct(
            e["label"].alias("label"), e["entity"].alias("entity"), e["unit"].alias("unit"), e["is_derived"].alias("is_derived"), held).alias("body"))

    documents = found.withColumn("_registered", registered).withColumn("s", F.transform("_registered", entry)).withColumns({
        "d0": F.array_min(F.transform("s", lambda e: F.array_min(F.transform(e["body"]["values"], lambda p: p["date"])))),
        "d1": F.array_max(F.transform("s", lambda e: F.array_max(F.transform(e["body"]["values"], lambda p: p["date"])))),
    })
    return documents.select(*by, F.to_json(F.struct(
        F.struct(
            *[F.lit(v).alias(k) for k, v in metadata.items()],
            F.col("d0").alias("start_date"), F.col("d1").alias("end_date"),
            F.col("s.key").alias("series_order"),
        ).alias("metadata"),
        F.map_from_entries(F.transform("s", lambda e: F.struct(e["key"], e["body"]))).alias("series"),
    )).alias("document"))


def to_market_performance(summary: DataFrame, performance: DataFrame, correlations: DataFrame,
                          metadata: dict[str, str]) -> DataFrame:
    """The market document: summary and series per market, and correlations."""
    fields = [c for c in performance.columns if c != "market"]
    series = performance.groupBy("market").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("series")
    )
    measures = F.struct(*[c for c in summary.columns if c != "market"])
    markets = summary.select("market", measures.alias("summary")).join(series, "market").agg(
        F.map_from_entries(F.sort_array(F.collect_list(
            F.struct("market", F.struct("summary", "series"))
        ))).alias("markets")
    )
    pairs = correlations.agg(F.sort_array(F.collect_list(
        F.struct("market_a", "market_b", F.col("corr").alias("correlation"))
    )))
    return markets.select(F.to_json(F.struct(
        F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()]).alias("metadata"),
        "markets", pairs.scalar().alias("correlations"),
    )).alias("document"))


def order_by_registry(df: DataFrame, registry: DataFrame, key: str = "id") -> DataFrame:
    """Rows in registered order; an id outside the registry is an error."""
    known = registry.select(key, "ordinal")
    joined = df.join(known, key, "left")
    guarded = F.when(F.col("ordinal").isNotNull(), F.col("ordinal")).otherwise(
        F.raise_error(F.concat(F.lit("Unregistered id: "), col(key).cast("string"))).cast("int")
    )
    return joined.withColumn("ordinal", guarded).orderBy("ordinal")


def freshness(inventory: DataFrame, as_of) -> DataFrame:
    """Age in days, stale flag by frequency, and availability of each output."""
    limit = F.lit(STALE_AFTER_DEFAULT)
    for name, days in STALE_AFTER_DAYS.items():
        limit = F.when(F.col("frequency") == name, F.lit(days)).otherwise(limit)
    age = F.greatest(F.datediff(F.lit(as_of).cast("date"), F.to_date("generated_at")), F.lit(0))
    return inventory.withColumns({
        "age_days": age, "stale_after_days": limit, "stale": age > limit,
        "availability": F.when(F.col("observations") > 0, F.lit("active")).otherwise("planned"),
    })


def assert_known(df: DataFrame, definitions: DataFrame, key: str = "indicator", defined: str = "key") -> DataFrame:
    """Records whose key has no definition (violation rows)."""
    return df.join(definitions.select(col(defined).alias(key)).distinct(), key, "left_anti")


# --- latest rows ---------------------------------------------------------------

def latest_change(df: DataFrame, keys=("entity",), order: str = "year", value: str = "value") -> DataFrame:
    """Earliest and latest non-null value per key and the change between them."""
    present = df.where(col(value).isNotNull())
    ends = present.groupBy(*keys).agg(
        F.min(order).alias("first_" + order), F.min_by(col(value), col(order)).alias("first_value"),
        F.max(order).alias("last_" + order), F.max_by(col(value), col(order)).alias("last_value"),
    )
    return ends.withColumn("change", F.col("last_value") - F.col("first_value"))


def latest_snapshot(wide: DataFrame, columns, year: str = "year") -> DataFrame:
    """Latest year with any value, unpivoted; categories without one keep null."""
    columns = list(columns)
    present = wide.dropna("all", subset=columns)
    # One row per year, so the largest row by year is the latest one.
    newest = present.agg(F.max_by(F.struct(year, *columns), col(year)).alias("_row"))
    return newest.select("_row.*").unpivot([year], columns, "category", "value")


def tail(df: DataFrame, order: str, n: int) -> DataFrame:
    """Last n rows; a top-k sort, not a full one."""
    return df.orderBy(col(order).desc()).limit(n)


def head(df: DataFrame, order: str, n: int) -> DataFrame:
    return df.orderBy(col(order)).limit(n)


def latest_points(df: DataFrame, keys=None, key: str = "indicator", limit: int | None = None, by=()) -> DataFrame:
    """Latest non-null point of each visible series within ``by``, optionally the first few."""
    present = df.where("value is not null")
    if keys is not None:
        present = present.where(col(key).isin(list(keys)))
    points = present.groupBy(*by, key).agg(
        F.max("date").alias("date"), F.max_by("value", "date").alias("value")
    )
    return points if limit is None else points.orderBy(*by, key).limit(limit)


def latest_year_rows(df: DataFrame, columns, year: str = "year") -> DataFrame:
    """Rows of the latest year on which all the listed columns are present."""
    present = df.dropna("any", subset=list(columns))
    newest = df.select(F.max(year)).scalar()
    return present.where(col(year) == newest)
