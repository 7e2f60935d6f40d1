"""Grouped summaries of flows, companies, quarters and outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query, r, rd
from tidemark.functions.scalars import map_category, offset_ratio
from tidemark.operators import growth as gr
from tidemark.operators import reshape as rs
from tidemark.operators import summaries as sm
from tidemark.session import settle

FLOWMAP = {"DII": "DII", "FII": "FPI", "FPI": "FPI", "FII/FPI": "FPI"}
MONTHLY = ("mf as (select date_trunc('month', date) as month, max(date) as date, coalesce(sum(net) filter (where category='DII'), 0) as DII, coalesce(sum(net) filter (where category<>'DII'), 0) as FPI from flows group by 1)")


def flows(spark, d):
    return fx.flows(spark, d).withColumn("category", map_category("category", FLOWMAP))


@query("a2_monthly_flows", "flows", f"with {MONTHLY} select CAST(month AS DATE) as month, date, {rd('DII', 3)} as DII, {rd('FPI', 3)} as FPI from mf")
def _(spark, d):
    return sm.monthly_flows(flows(spark, d)).select("month", "date", r("DII", 3), r("FPI", 3))


@query("a49_offset_ratio", "flows", "with w as (select date, max(net) filter (where category='DII') as i, max(net) filter (where category<>'DII') as o from flows group by 1)"
       f" select date, {rd('CASE WHEN o < 0 THEN greatest(i, 0) / abs(o) END')} as ratio from w")
def _(spark, d):
    w = rs.to_wide(flows(spark, d), ["DII", "FPI"], "date", "category", "net")
    # GREATEST skips a missing inflow in SQL, which counts it as zero.
    return w.select("date", r(offset_ratio("DII", "FPI"), 6, "ratio"))


UTIL = (f"u as (select n_name as entity, last_day(CAST(o_orderdate AS DATE)) as date, 100.0::DOUBLE * count(*) filter (where o_orderstatus='F') / count(*) as value from {fx.GEO} group by 1,2)")


@query("a3_fiscalise", sql=f"with {UTIL} select entity, CAST(year(date + INTERVAL 9 MONTH) AS INT) as fy, make_date(CAST(year(date + INTERVAL 9 MONTH) AS INT), 3, 31) as date, {rd('avg(value)')} as value from u group by 1,2,3")
def _(spark, d):
    share = F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))
    used = fx.geography(spark, d).groupBy(F.col("n_name").alias("entity"), F.last_day(F.col("o_orderdate").cast("date")).alias("date")).agg(share.alias("value"))
    return sm.fiscalise(used, "value", ("entity",)).select("entity", "fy", "date", r("value"))


def quarter_sql(stat: str) -> str:
    return ("select entity, indicator, last_day(make_date(CAST(year(date) AS INT), CAST(quarter(date) * 3 AS INT), 1)) as date,"
            f" {rd(stat, 6)} as value, arg_max(status, date) as status, count(distinct month(date)) = 3 as complete from records group by 1,2,3")


for how, stat in (("mean", "avg(value)"), ("sum", "sum(value)"), ("last", "arg_max(value, date)")):
    @query(f"a4_to_quarter_{how}", "records", quarter_sql(stat))
    def _(spark, d, how=how):
        recs = fx.records(spark, d).withColumn("source_date", F.col("date"))
        return sm.to_quarter(recs, how, ("entity", "indicator")).select("entity", "indicator", "date", r("value", 6), "status", "complete")


GROWN = "with g as (select grp, fy, (revenue / lag(revenue) over (partition by company_key order by fy) - 1) * 100 as x from fundamentals)"


@query("a5_group_median", "fundamentals", f"{GROWN} select grp, fy, {rd('median(x)')} as median_revenue_growth from g where x is not null group by 1,2")
def _(spark, d):
    g = gr.pct_change(fx.fundamentals(spark, d), "revenue", ("company_key",), "fy", "revenue_growth", 100.0)
    return sm.group_median(g, "revenue_growth").select("grp", "fy", r("median_revenue_growth"))


@query("a7_coverage", "fundamentals", "select company_key, arg_min(grp, fy) as grp, min(fy) as start_year, max(fy) as end_year, count(*) as observations from fundamentals group by 1")
def _(spark, d):
    return sm.coverage(fx.fundamentals(spark, d), ["company_key"], "grp", "fy")


BT = ("b as (select year, v as actual, lag(v) over (order by year) as previous, n as balance from (select CAST(year(o_orderdate)*100+month(o_orderdate) AS INT) as year, CAST(count(*) AS DOUBLE) as v, CAST(count(*) filter (where o_orderstatus='F') AS DOUBLE) as n"
      " from orders group by 1)), p as (select year, actual, previous * 1.07 / 1.1 - balance as predicted from b where previous is not null)")


def backtest_rows(spark, d):
    m = fx.table(spark, d, "orders").groupBy(F.last_day(F.col("o_orderdate").cast("date")).alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("v"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("n"))
    debt = m.select("date", F.col("v").alias("value"), F.lit("actual").alias("status"))
    return sm.backtest(debt, m.select("date", F.col("n").alias("value")), 7.0, 10.0)


@query("a43_backtest", sql=f"with {BT}, q as (select *, predicted - actual as e from p order by year desc limit 10) select {rd('avg(abs(e))')} as mae, {rd('sqrt(avg(e * e))')} as rmse, count(*) as n from q")
def _(spark, d):
    return sm.backtest_errors(backtest_rows(spark, d)).select(r("mae"), r("rmse"), "n")


@query("t7_tail", sql=f"with {BT} select year, {rd('predicted - actual')} as error from p order by year desc limit 10")
def _(spark, d):
    rows = rs.tail(backtest_rows(spark, d), "date", 10)
    return rows.select((F.year("date") * 100 + F.month("date")).cast("int").alias("year"), r("error"))


@query("t7_head", "records", "select date, indicator, entity from records order by date, indicator, entity limit 5")
def _(spark, d):
    return fx.records(spark, d).orderBy("date", "indicator", "entity").limit(5).select("date", "indicator", "entity")


@query("a44_scatter_reference", "records", "with p as (select x.entity, x.value as x, y.value as y, z.value as z from records x join records y on x.entity=y.entity and x.date=y.date"
       " left join records z on z.entity=x.entity and z.date=x.date and z.indicator='FURNITURE' where x.indicator='BUILDING' and y.indicator='MACHINERY')"
       f" select entity, {rd('median(x)', 6)} as median_x, {rd('median(y)', 6)} as median_y, min(z) as min_z, max(z) as max_z from p group by 1")
def _(spark, d):
    records = settle(fx.records(spark, d))
    p = settle(sm.scatter_points(*[records.where(F.col("indicator") == s) for s in ("BUILDING", "MACHINERY", "FURNITURE")], ("entity", "date")))
    return sm.scatter_reference(p, ("entity",)).select("entity", r("median_x", 6), r("median_y", 6), "min_z", "max_z")


@query("a46_exclusion_summary", "records", "select indicator as input, CASE WHEN date < DATE '1996-01-01' THEN 'before_start' ELSE 'status' END as reason, count(*) as n from records where date < DATE '1996-01-01' or status <> 'actual' group by 1,2")
def _(spark, d):
    reason = F.when(F.col("date") < F.lit("1996-01-01").cast("date"), "before_start").when(F.col("status") != "actual", "status")
    return sm.exclusion_summary(fx.records(spark, d).select(F.col("indicator").alias("input"), reason.alias("reason")))


@query("a47_inventory", "records", "select indicator as output, count(distinct entity) as series, count(*) as observations, min(date) as start_date, max(date) as end_date from records group by 1")
def _(spark, d):
    return sm.inventory(fx.records(spark, d).select(F.col("indicator").alias("output"), F.col("entity").alias("series"), "date"))


@query("a48_non_null_counts", "country_year", "select entity as series, count(value) as n from country_year group by 1")
def _(spark, d):
    names = [f"NATION_{k}" for k in range(25)]
    return sm.non_null_counts(rs.to_wide(fx.country_year(spark, d), names, "year", "entity"), names)
