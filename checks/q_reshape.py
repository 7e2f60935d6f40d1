"""Set operations, wide and long shapes, documents, latest rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import fixtures as fx
from checks.registry import query, r, rd
from tidemark.operators import correlation as co
from tidemark.operators import market as mk
from tidemark.operators import reshape as rs
from tidemark.session import settle

FIVE = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("u1_union_records", "records", "select date, entity, indicator, value, status from records union all select date, entity, indicator || '_x', value * 2, status from records where indicator = 'BUILDING'")
def _(spark, d):
    recs = fx.records(spark, d)
    extra = recs.where("indicator = 'BUILDING'").select("status", "value", "indicator", "entity", "date").withColumns(
        {"value": F.col("value") * 2, "indicator": F.concat("indicator", F.lit("_x"))})
    return rs.union_records(recs, extra)


@query("u2_key_diff", sql="with a as (select distinct o_custkey as k from orders where o_orderstatus='F'), b as (select distinct o_custkey as k from orders where o_orderstatus='P')"
       " select k as o_custkey, 'missing' as side from a where k not in (select k from b) union all select k, 'unexpected' from b where k not in (select k from a)")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    return rs.key_diff(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), "o_custkey")


WIDE = ", ".join(f"max(price) filter (where market='{m}') as \"{m}\"" for m in FIVE)


@query("u4_to_wide", "prices_m", f"select date, {WIDE} from prices_m group by 1")
def _(spark, d):
    return rs.to_wide(fx.prices_m(spark, d), FIVE, "date", "market", "price")


COUNTRIES = [f"NATION_{i}" for i in range(25)]
CW = ", ".join(f"max(value) filter (where entity='{c}') as {c}" for c in COUNTRIES)


@query("u5_countries_wide", "country_year", f"select year, {CW} from country_year group by 1")
def _(spark, d):
    return rs.to_wide(fx.country_year(spark, d), COUNTRIES, "year", "entity")


@query("u6_to_long", "prices_w", "select date, market as series, price as value from prices_w")
def _(spark, d):
    wide = rs.to_wide(fx.prices_w(spark, d), FIVE, "date", "market", "price")
    return rs.to_long(wide, ["date"], FIVE).where("value is not null")


@query("u7_densify_years", "country_year", "with e as (select distinct entity from country_year), y as (select CAST(unnest(range(1993, 2004)) AS INT) as year) select e.entity, y.year, value from e cross join y left join country_year c on c.entity=e.entity and c.year=y.year")
def _(spark, d):
    return rs.densify_years(fx.country_year(spark, d), 1993, 2003)


@query("t1_canonical_order", "records", "select date, indicator, entity, value from records order by date, indicator, entity")
def _(spark, d):
    return rs.canonical_order(fx.records(spark, d)).select("date", "indicator", "entity", "value")


def definitions(spark, d):
    keys = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("key")).distinct()
    return keys.select(F.crc32("key").alias("ordinal"), "key", F.initcap("key").alias("label"), F.lit("IND").alias("entity"), F.lit("INR").alias("unit"), F.lit(False).alias("is_derived"))


def national(spark, d):
    return fx.records(spark, d).withColumn("period_label", F.date_format("date", "yyyy-MM"))


@query("u8_to_dated_multi_series", "records", "select entity, indicator as key, count(*) as n, min(date) as first_date, max(date) as last_date, arg_max(value, date) as last_value, arg_min(status, date) as first_status from records group by 1,2")
def _(spark, d):
    doc = rs.to_dated_multi_series(national(spark, d), definitions(spark, d), {"frequency": "monthly"}, ("entity",))
    point = T.StructType([T.StructField("date", T.DateType()), T.StructField("value", T.DoubleType()), T.StructField("status", T.StringType())])
    body = T.StructType([T.StructField("values", T.ArrayType(point))])
    schema = T.StructType([T.StructField("series", T.MapType(T.StringType(), body))])
    parsed = doc.select("entity", F.explode(F.from_json("document", schema)["series"]).alias("key", "b"))
    # A defined series without records has an empty list.
    v = F.col("b.values")
    return parsed.where(F.size(v) > 0).select("entity", "key", F.size(v).cast("bigint").alias("n"), F.get(v, F.lit(0))["date"].alias("first_date"), F.try_element_at(v, F.lit(-1))["date"].alias("last_date"),
                         F.try_element_at(v, F.lit(-1))["value"].alias("last_value"), F.get(v, F.lit(0))["status"].alias("first_status"))


@query("u9_to_market_performance", "ret_m", f"select market, count(*) as n, CAST(max(year(date)) AS DOUBLE) as last_year, {rd('arg_max(price, date) / arg_min(price, date) - 1')} as total_return from ret_m group by 1")
def _(spark, d):
    prices = settle(mk.with_returns(fx.prices_m(spark, d)))
    pairs = co.pearson_matrix(prices, co.unordered_pairs(spark, FIVE))
    doc = rs.to_market_performance(mk.total_return(prices), prices, pairs, {"interval": "monthly"})
    summary = T.StructType([T.StructField("total_return", T.DoubleType())])
    point = T.StructType([T.StructField("date", T.DateType())])
    market = T.StructType([T.StructField("summary", summary), T.StructField("series", T.ArrayType(point))])
    schema = T.StructType([T.StructField("markets", T.MapType(T.StringType(), market))])
    m = doc.select(F.explode(F.from_json("document", schema)["markets"]).alias("market", "b"))
    return m.select("market", F.size("b.series").cast("bigint").alias("n"), F.year(F.element_at("b.series", -1)["date"]).cast("double").alias("last_year"),
                    r(F.col("b.summary.total_return"), 6, "total_return"))


@query("u10_order_by_registry", sql="select c_custkey as id, CAST(c_nationkey AS INT) as ordinal from customer")
def _(spark, d):
    registry = fx.table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("int").alias("ordinal"))
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("key"))
    return rs.order_by_registry(c, registry, "key").select("id", "ordinal")


FREQ = "CASE WHEN c_nationkey % 3 = 0 THEN 'monthly' WHEN c_nationkey % 3 = 1 THEN 'annual' ELSE 'other' END"


@query("u11_freshness", sql=f"with i as (select c_custkey as output, max(o_orderdate) as generated_at, count(o_orderkey) as observations, {FREQ} as frequency from customer left join orders on c_custkey=o_custkey group by 1, c_nationkey),"
       " a as (select *, CAST(greatest(date_diff('day', CAST(generated_at AS DATE), DATE '2001-08-01'), 0) AS INT) as age_days, CAST(CASE frequency WHEN 'monthly' THEN 45 WHEN 'annual' THEN 450 ELSE 120 END AS INT) as lim from i)"
       " select output, age_days, age_days > lim as stale, CASE WHEN observations > 0 THEN 'active' ELSE 'planned' END as availability from a where observations > 0")
def _(spark, d):
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("generated_at"), F.count(F.lit(1)).alias("observations"))
    k = F.col("c_nationkey") % 3
    inv = fx.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select(
        F.col("c_custkey").alias("output"), "generated_at", "observations", F.when(k == 0, "monthly").when(k == 1, "annual").otherwise("other").alias("frequency"))
    return rs.freshness(inv, "2001-08-01").select("output", "age_days", "stale", "availability")


@query("t5_latest_change", "country_year", f"select entity, min(year) as first_year, arg_min(value, year) as first_value, max(year) as last_year, arg_max(value, year) as last_value, {rd('arg_max(value, year) - arg_min(value, year)', 5)} as change from country_year group by 1")
def _(spark, d):
    out = rs.latest_change(fx.country_year(spark, d))
    return out.select("entity", "first_year", "first_value", "last_year", "last_value", r("change", 5))


@query("t6_latest_snapshot", "country_year", "with l as (select max(year) as y from country_year) select CAST(y AS INT) as year, n_name as category, value from l cross join nation left join country_year c on c.year = l.y and c.entity = n_name")
def _(spark, d):
    names = [f"NATION_{k}" for k in range(25)]
    return rs.latest_snapshot(rs.to_wide(fx.country_year(spark, d), names, "year", "entity"), names)


@query("t8_latest_points", "records", "select entity, indicator, max(date) as date, arg_max(value, date) as value from records group by 1,2")
def _(spark, d):
    return rs.latest_points(fx.records(spark, d), by=("entity",))


@query("t9_latest_year_rows", "projects", f"select sector, year, on_schedule, original_cost from projects where year = (select max(year) from projects) and on_schedule > 0")
def _(spark, d):
    p = fx.projects(spark, d).withColumn("on_schedule", F.when(F.col("on_schedule") > 0, F.col("on_schedule")))
    return rs.latest_year_rows(p, ("on_schedule", "original_cost")).select("sector", "year", "on_schedule", "original_cost")


