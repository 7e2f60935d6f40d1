"""Shapes the operators need, derived from the driver tables.

Each fixture exists twice: as a DataFrame and as a named SQL expression with
the same columns.  Money is summed as decimals, so both engines and any
partitioning give bit-identical doubles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MONEY = "decimal(18,2)"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dsum(c: str):
    return F.sum(F.col(c).cast(MONEY)).cast("double")


def davg(c: str):
    return dsum(c) / F.count(F.lit(1))


def xsum(expr: str):
    return F.expr(f"cast(sum({expr}) as double)")


EXT = "cast(l_extendedprice as decimal(18,2))"
DISC = "cast(l_discount as decimal(5,2))"
TAX = "cast(l_tax as decimal(5,2))"
PRICE = "cast(o_totalprice as decimal(18,2))"


def fy(c: str):
    return F.year(F.add_months(F.col(c).cast("date"), 9)).cast("int")


FY_SHIP = "CAST(year(CAST(l_shipdate AS DATE) + INTERVAL 9 MONTH) AS INT)"


def geography(spark, d):
    """Orders with the nation and region of their customer."""
    orders, customer = table(spark, d, "orders"), table(spark, d, "customer")
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    places = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return orders.join(places, F.col("o_custkey") == F.col("c_custkey"))


def prices_m(spark, d):
    return geography(spark, d).groupBy(
        F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date"), F.col("r_name").alias("market")
    ).agg(dsum("o_totalprice").alias("price"))


def prices_d(spark, d):
    return table(spark, d, "events").groupBy(
        F.col("ts").cast("date").alias("date"), F.col("event_type").alias("market")
    ).agg(davg("value").alias("price"))


def ticks(spark, d):
    return table(spark, d, "events").select(
        "event_id", "ts", F.col("event_type").alias("market"), F.col("value").alias("price")
    )


def prices_w(spark, d):
    """Order value per order day and region: long daily histories."""
    return geography(spark, d).groupBy(
        F.col("o_orderdate").cast("date").alias("date"), F.col("r_name").alias("market")
    ).agg(dsum("o_totalprice").alias("price"))


def capex_fy(spark, d):
    return table(spark, d, "lineitem").groupBy(fy("l_shipdate").alias("fy")).agg(
        dsum("l_extendedprice").alias("value")
    )


def snapshots(spark, d):
    y = table(spark, d, "lineitem").groupBy(fy("l_shipdate").alias("fy")).agg(
        xsum(f"{EXT} * (1 - {DISC})").alias("actual"),
        dsum("l_extendedprice").alias("budget"),
        xsum(f"{EXT} * (1 + {TAX})").alias("total"),
    )
    # One row per fiscal year, so a window over all of them is short.
    def years_ago(c: str, n: int):
        return F.first(c).over(W.orderBy("fy").rangeBetween(-n, -n))

    edition = y.select(
        F.col("fy").alias("edition"), F.col("budget").alias("current_budget_capex"),
        (years_ago("budget", 1) * 0.98).alias("prior_revised_capex"), years_ago("actual", 2).alias("actual_capex"),
        years_ago("total", 2).alias("actual_total_expenditure"),
    )
    return edition.where("prior_revised_capex is not null and actual_capex is not null")


def panel(spark, d):
    lines = table(spark, d, "lineitem")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    places = table(spark, d, "customer").join(
        table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", "n_name")
    # Orders get their place first, so that lines are shuffled once.
    placed = orders.join(places, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    return lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("n_name").alias("state"), fy("l_shipdate").alias("fy")).agg(
        dsum("l_extendedprice").alias("current_value"), dsum("l_quantity").alias("constant_value"),
        xsum(f"{EXT} * {DISC}").alias("outlay"),
    )


def fundamentals(spark, d):
    return table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("company_key"),
        F.when(F.col("l_suppkey") % 2 == 0, "capital_goods").otherwise("infrastructure").alias("grp"),
        fy("l_shipdate").alias("fy"),
    ).agg(
        dsum("l_extendedprice").alias("revenue"), xsum(f"{EXT} * (1 - {DISC})").alias("ebitda"),
        xsum(f"{EXT} * {TAX}").alias("capex"), dsum("l_quantity").alias("net_ppe"),
        xsum(f"{EXT} * {DISC}").alias("debt"),
    )


def projects(spark, d):
    return table(spark, d, "orders").groupBy(
        F.col("o_orderpriority").alias("sector"), F.year("o_orderdate").cast("int").alias("year")
    ).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("on_schedule"),
        F.count_if(F.col("o_orderstatus") == "O").alias("delayed_n"),
        F.count_if(F.col("o_orderstatus") == "P").alias("undated"),
        dsum("o_totalprice").alias("original_cost"),
        xsum(f"{PRICE} * case when o_orderstatus = 'O' then 1.1 else 1.0 end").alias("anticipated_cost"),
    )


def records(spark, d):
    return geography(spark, d).groupBy(
        F.last_day(F.col("o_orderdate").cast("date")).alias("date"),
        F.col("n_name").alias("entity"), F.col("c_mktsegment").alias("indicator"),
    ).agg(
        davg("o_totalprice").alias("value"),
        F.min(F.when(F.col("o_orderstatus") == "F", "actual").when(F.col("o_orderstatus") == "P", "provisional")
              .otherwise("revised")).alias("status"),
    )


def flows(spark, d):
    return table(spark, d, "orders").groupBy(
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(F.col("o_custkey") % 2 == 0, "DII").otherwise("FII/FPI").alias("category"),
    ).agg(
        xsum(f"case when o_orderstatus = 'F' then {PRICE} else 0 end").alias("buy"),
        xsum(f"case when o_orderstatus <> 'F' then {PRICE} * 0.5 else 0 end").alias("sell"),
        xsum(f"case when o_orderstatus = 'F' then {PRICE} else {PRICE} * -0.5 end").alias("net"),
    )


def monthly_volume(spark, d):
    return table(spark, d, "orders").groupBy(
        F.year("o_orderdate").cast("int").alias("y"), F.month("o_orderdate").cast("int").alias("m")
    ).agg(F.count(F.lit(1)).alias("volume"), dsum("o_totalprice").alias("value"))


def country_year(spark, d):
    return geography(spark, d).groupBy(
        F.col("n_name").alias("entity"), F.year("o_orderdate").cast("int").alias("year")
    ).agg(davg("o_totalprice").alias("value"))


def regression_w(spark, d):
    """Monthly order value per nation against time: one small sample per group."""
    return geography(spark, d).groupBy(
        F.col("r_name").alias("grp"), F.trunc(F.col("o_orderdate").cast("date"), "month").alias("date")
    ).agg(
        (dsum("o_totalprice") / 1e6).alias("y"), F.count(F.lit(1)).cast("double").alias("x1"),
        F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("x2"),
    )


def text_rows(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.concat(F.lit("Capital Expenditure "), F.col("l_extendedprice").cast(MONEY).cast("string"), F.lit(" "),
                 F.col("l_quantity").cast("int").cast("string")).alias("text"),
        F.col("l_shipdate").cast("date").alias("shipdate"),
    )


def cells(spark, d):
    """Published-looking number cells from order values."""
    k = F.col("o_orderkey") % 7
    p = F.col("o_totalprice").cast(MONEY).cast("string")
    grouped = F.regexp_replace(p, r"^(\d+)(\d{3}\.)", "$1,$2")
    text = (
        F.when(k == 0, p).when(k == 1, grouped).when(k == 2, F.concat(F.lit("("), p, F.lit(")")))
        .when(k == 3, F.lit("-")).when(k == 4, F.lit("..")).when(k == 5, F.lit("n/a")).otherwise(F.lit(""))
    )
    return table(spark, d, "orders").select("o_orderkey", text.alias("cell"))


def events_w(spark):
    return spark.sql(
        "select * from values ('w1', date'2024-01-03', date'2024-01-09'),"
        " ('w2', date'2024-01-15', date'2024-01-22') t(event_id, start_date, end_date)"
    )


GEO = ("orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey"
       " join region on n_regionkey=r_regionkey")
DSUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"
MONTH = "CAST(date_trunc('month',{}) AS DATE)"
EXT_S, DISC_S, TAX_S, PRICE_S = (x.replace("cast(", "CAST(") for x in (EXT, DISC, TAX, PRICE))


def s(expr: str) -> str:
    return DSUM.format(expr)


def xs(expr: str) -> str:
    return f"CAST(sum({expr}) AS DOUBLE)"


# name -> (names it needs, SQL)
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "prices_m": ((), f"select {MONTH.format('o_orderdate')} as date, r_name as market, {s('o_totalprice')} as price from {GEO} group by 1,2"),
    "prices_d": ((), f"select CAST(ts AS DATE) as date, event_type as market, {s('value')}/count(*) as price from events group by 1,2"),
    "prices_w": ((), f"select CAST(o_orderdate AS DATE) as date, r_name as market, {s('o_totalprice')} as price from {GEO} group by 1,2"),
    "capex_fy": ((), f"select {FY_SHIP} as fy, {s('l_extendedprice')} as value from lineitem group by 1"),
    "snap_y": ((), f"select {FY_SHIP} as fy, {xs(f'{EXT_S}*(1-{DISC_S})')} as actual, {s('l_extendedprice')} as budget,"
                   f" {xs(f'{EXT_S}*(1+{TAX_S})')} as total from lineitem group by 1"),
    "snapshots": (("snap_y",), "select c.fy as edition, a.actual as actual_capex, r.budget*0.98 as prior_revised_capex,"
                  " c.budget as current_budget_capex, a.total as actual_total_expenditure"
                  " from snap_y c join snap_y r on r.fy=c.fy-1 join snap_y a on a.fy=c.fy-2"),
    "panel": ((), f"select n_name as state, {FY_SHIP} as fy, {s('l_extendedprice')} as current_value, {s('l_quantity')} as constant_value,"
                  f" {xs(f'{EXT_S}*{DISC_S}')} as outlay from lineitem join orders on l_orderkey=o_orderkey"
                  " join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by 1,2"),
    "fundamentals": ((), f"select l_suppkey as company_key, CASE WHEN l_suppkey%2=0 THEN 'capital_goods' ELSE 'infrastructure' END as grp,"
                         f" {FY_SHIP} as fy, {s('l_extendedprice')} as revenue, {xs(f'{EXT_S}*(1-{DISC_S})')} as ebitda,"
                         f" {xs(f'{EXT_S}*{TAX_S}')} as capex, {s('l_quantity')} as net_ppe, {xs(f'{EXT_S}*{DISC_S}')} as debt"
                         " from lineitem group by 1,2,3"),
    "projects": ((), "select o_orderpriority as sector, CAST(year(o_orderdate) AS INT) as year,"
                     " count(*) filter (where o_orderstatus='F') as on_schedule, count(*) filter (where o_orderstatus='O') as delayed_n,"
                     f" count(*) filter (where o_orderstatus='P') as undated, {s('o_totalprice')} as original_cost,"
                     f" {xs(f'{PRICE_S} * CASE WHEN o_orderstatus={chr(39)}O{chr(39)} THEN 1.1 ELSE 1.0 END')} as anticipated_cost"
                     " from orders group by 1,2"),
    "records": ((), f"select last_day(CAST(o_orderdate AS DATE)) as date, n_name as entity, c_mktsegment as indicator, {s('o_totalprice')}/count(*) as value,"
                    " min(CASE o_orderstatus WHEN 'F' THEN 'actual' WHEN 'P' THEN 'provisional' ELSE 'revised' END) as status"
                    f" from {GEO} group by 1,2,3"),
    "flows": ((), "select CAST(o_orderdate AS DATE) as date, CASE WHEN o_custkey%2=0 THEN 'DII' ELSE 'FII/FPI' END as category,"
                  f" {xs(f'CASE WHEN o_orderstatus={chr(39)}F{chr(39)} THEN {PRICE_S} ELSE 0 END')} as buy,"
                  f" {xs(f'CASE WHEN o_orderstatus<>{chr(39)}F{chr(39)} THEN {PRICE_S}*0.5 ELSE 0 END')} as sell,"
                  f" {xs(f'CASE WHEN o_orderstatus={chr(39)}F{chr(39)} THEN {PRICE_S} ELSE {PRICE_S}*-0.5 END')} as net"
                  " from orders group by 1,2"),
    "monthly_volume": ((), f"select CAST(year(o_orderdate) AS INT) as y, CAST(month(o_orderdate) AS INT) as m, count(*) as volume, {s('o_totalprice')} as value from orders group by 1,2"),
    "country_year": ((), f"select n_name as entity, CAST(year(o_orderdate) AS INT) as year, {s('o_totalprice')}/count(*) as value from {GEO} group by 1,2"),
    "regression_w": ((), f"select r_name as grp, {MONTH.format('o_orderdate')} as date, {s('o_totalprice')}/1e6 as y, CAST(count(*) AS DOUBLE) as x1,"
                         f" CAST(count(*) filter (where o_orderstatus='F') AS DOUBLE) as x2 from {GEO} group by 1,2"),
    "text_rows": ((), "select l_orderkey, l_linenumber, 'Capital Expenditure ' || CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) || ' '"
                      " || CAST(CAST(l_quantity AS INT) AS VARCHAR) as text, CAST(l_shipdate AS DATE) as shipdate from lineitem"),
    "cells": ((), "select o_orderkey, CASE o_orderkey%7 WHEN 0 THEN p WHEN 1 THEN regexp_replace(p, '^(\\d+)(\\d{3}\\.)', '\\1,\\2')"
                  " WHEN 2 THEN '(' || p || ')' WHEN 3 THEN '-' WHEN 4 THEN '..' WHEN 5 THEN 'n/a' ELSE '' END as cell"
                  " from (select o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) as p from orders)"),
    "events_w": ((), "select * from (values ('w1',DATE '2024-01-03',DATE '2024-01-09'),('w2',DATE '2024-01-15',DATE '2024-01-22')) t(event_id,start_date,end_date)"),
    # Shared intermediate shapes.
    "ret_m": (("prices_m",), "select *, price/lag(price) over (partition by market order by date)-1 as ret from prices_m"),
    "ret_d": (("prices_d",), "select *, price/lag(price) over (partition by market order by date)-1 as ret from prices_d"),
    "ret_w": (("prices_w",), "select *, price/lag(price) over (partition by market order by date)-1 as ret from prices_w"),
}


def with_sql(names: str, body: str) -> str:
    """A query over named fixtures, with everything they need before it."""
    ordered: list[str] = []

    def need(name: str) -> None:
        if name in ordered:
            return
        for dep in SQL[name][0]:
            need(dep)
        ordered.append(name)

    for name in names.split():
        need(name)
    if not ordered:
        return body
    parts = ", ".join(f"{n} as ({SQL[n][1]})" for n in ordered)
    if body.lstrip().lower().startswith("with "):
        return f"with {parts}, {body.lstrip()[5:]}"
    return f"with {parts} {body}"
