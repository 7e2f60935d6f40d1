"""Vintages, denominators, growth rules, lag pairing and window joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import corr_sql, query, r, rd
from tidemark.functions import calendar as cal
from tidemark.operators import growth as gr
from tidemark.operators import lagged as lg
from tidemark.operators import market as mk
from tidemark.operators import reshape as rs
from tidemark.operators import summaries as sm
from tidemark.operators import vintages as vt
from tidemark.session import settle

VINTAGE = ("v as (select fy, max(b) as budget, max(rv) as revised, max(a) as actual, max(t) as total_expenditure from ("
           "select edition as fy, current_budget_capex as b, NULL as rv, NULL as a, NULL as t from snapshots"
           " union all select edition - 1, NULL, prior_revised_capex, NULL, NULL from snapshots"
           " union all select edition - 2, NULL, NULL, actual_capex, actual_total_expenditure from snapshots) group by 1)")


@query("j1_assemble_vintages", "snapshots", f"with {VINTAGE} select CAST(fy AS INT) as fy, {rd('budget', 4)} as budget, {rd('revised', 4)} as revised,"
       f" {rd('actual', 4)} as actual, {rd('total_expenditure', 4)} as total_expenditure from v")
def _(spark, d):
    v = vt.assemble_vintages(fx.snapshots(spark, d))
    return v.select("fy", *[r(c, 4) for c in ("budget", "revised", "actual", "total_expenditure")])


@query("j2_execution_ratio", "snapshots", f"with {VINTAGE} select CAST(fy AS INT) as fy, {rd('actual * 100 / budget')} as execution_ratio from v where actual is not null and budget is not null")
def _(spark, d):
    return vt.execution_ratio(vt.assemble_vintages(fx.snapshots(spark, d))).select("fy", r("execution_ratio"))


@query("j3_with_denominator", "country_year", f"with n as (select CAST(year(o_orderdate) AS INT) as year, {fx.s('o_totalprice')} as total from orders where o_orderstatus = 'F' and year(o_orderdate) < 2001 group by 1)"
       f" select c.entity, c.year, value, {rd('value * 100 / total')} as share from country_year c left join n on c.year = n.year")
def _(spark, d):
    totals = fx.table(spark, d, "orders").where("o_orderstatus = 'F' and year(o_orderdate) < 2001").groupBy(
        F.year("o_orderdate").cast("int").alias("year")).agg(fx.dsum("o_totalprice").alias("total"))
    out = vt.with_denominator(fx.country_year(spark, d), totals, "year", "value", "total", "share")
    return out.select("entity", "year", "value", r("share"))


@query("j4_ratio_series", "flows", "with a as (select date, buy from flows where category='DII'), b as (select date, buy from flows where category='FII/FPI')"
       f" select a.date, {rd('CASE WHEN b.buy <> 0 THEN a.buy * 100 / b.buy END', 4)} as value from a join b on a.date=b.date")
def _(spark, d):
    f = fx.flows(spark, d).withColumnRenamed("buy", "value")
    out = vt.ratio_series(f.where("category = 'DII'"), f.where("category = 'FII/FPI'"))
    return out.select("date", r("value", 4))


LAGYEAR = "first_value({v}) over (partition by entity order by year range between {o} and {o})"


@query("j7_lead_year_growth", "panel", "with g as (select state, fy, constant_value as v, first_value(constant_value) over (partition by state order by fy range between 1 following and 1 following) as nv from panel)"
       f" select state, fy, {rd('(nv / v - 1) * 100')} as next_growth from g")
def _(spark, d):
    return gr.lead_year_growth(fx.panel(spark, d)).select("state", "fy", r("next_growth"))


GROWTH = ("drv as (select fy, make_date(fy, 3, 31) as date, (value / lag(value) over (order by fy) - 1) * 100 as driver from capex_fy)")
OUTC = ("outc as (select entity as outcome_key, make_date(year, 3, 31) as date, value as outcome from country_year)")


def driver(spark, d):
    base = fx.capex_fy(spark, d).select(F.make_date("fy", F.lit(3), F.lit(31)).alias("date"), "value")
    return gr.pct_change(base, "value", (), "date", "driver", 100.0).select("date", "driver")


def outcomes(spark, d):
    return fx.country_year(spark, d).select(
        F.col("entity").alias("outcome_key"), F.make_date("year", F.lit(3), F.lit(31)).alias("date"), F.col("value").alias("outcome"))


PAIRS = ("lp as (select outcome_key, CAST(lag AS INT) as lag, drv.date, driver, outcome, CAST(year(drv.date) AS INT) as year from drv cross join (values (0),(1),(2),(3)) l(lag)"
         " join outc on outc.date = CAST(drv.date + to_years(CAST(lag AS INT)) AS DATE) where driver is not null)")


@query("j8_lag_pairs", "capex_fy country_year", f"with {GROWTH}, {OUTC}, {PAIRS} select outcome_key, lag, date, {rd('driver')} as driver, outcome, year from lp")
def _(spark, d):
    return lg.lag_pairs(driver(spark, d), outcomes(spark, d), (0, 1, 2, 3)).select("outcome_key", "lag", "date", r("driver"), "outcome", "year")


def lagcorr_sql(source: str, keys: str, excluded: str = "1997, 1998") -> str:
    keep = f"year not in ({excluded})"
    kx, ky = f"CASE WHEN {keep} THEN driver END", f"CASE WHEN {keep} THEN outcome END"
    return (f"rk as (select *, rank() over (partition by {keys} order by driver) + (count(*) over (partition by {keys}, driver) - 1) / 2.0 as rx,"
            f" rank() over (partition by {keys} order by outcome) + (count(*) over (partition by {keys}, outcome) - 1) / 2.0 as ry from {source}),"
            f" lc as (select {keys}, count(*) as n, count(*) filter (where {keep}) as n_excluding,"
            f" CASE WHEN count(*) >= 3 THEN {corr_sql('driver', 'outcome')} END as pearson, CASE WHEN count(*) >= 3 THEN {corr_sql('rx', 'ry')} END as spearman,"
            f" CASE WHEN count(*) filter (where {keep}) >= 3 THEN {corr_sql(kx, ky)} END as pearson_excluding from rk group by {keys})")


@query("a25_lag_correlations", "capex_fy country_year", f"with {GROWTH}, {OUTC}, {PAIRS}, {lagcorr_sql('lp', 'outcome_key, lag')}"
       f" select outcome_key, lag, {rd('pearson')} as pearson, {rd('spearman')} as spearman, n, {rd('pearson_excluding')} as pearson_excluding, n_excluding from lc")
def _(spark, d):
    t = lg.lag_correlations(lg.lag_pairs(driver(spark, d), outcomes(spark, d), (0, 1, 2, 3)), ("outcome_key", "lag"), (1997, 1998))
    return t.select("outcome_key", "lag", r("pearson"), r("spearman"), "n", r("pearson_excluding"), "n_excluding")


@query("a26_lag_ladder", "capex_fy country_year", f"with {GROWTH}, {OUTC}, {PAIRS}, {lagcorr_sql('lp', 'outcome_key, lag')}"
       f" select outcome_key, lag, n, {rd('pearson')} as pearson, {rd('spearman')} as spearman, n >= 6 as eligible, CASE WHEN n >= 6 THEN 'associational' ELSE 'insufficient_data' END as status from lc")
def _(spark, d):
    t = lg.lag_ladder(driver(spark, d), outcomes(spark, d), required=6)
    return t.select("outcome_key", "lag", "n", r("pearson"), r("spearman"), "eligible", "status")


def window_sql(start: str, shifts: str) -> str:
    return (f"win as (select market, a.date as anchor, CAST(o AS INT) as offset_months, (product(1 + ret) - 1) * 100 as window_return, count(*) as n from drv a cross join (values {shifts}) s(o)"
            f" join ret_m m on m.date > {start} and m.date <= last_day(CAST({start} + INTERVAL 12 MONTH AS DATE)) where ret is not null group by 1,2,3 having count(*) >= 9)")


WS_FWD = "last_day(CAST(a.date + to_months(CAST(o AS INT)) AS DATE))"
WS_BACK = "last_day(CAST(a.date - to_months(CAST(o AS INT) + 12) AS DATE))"


@query("j9_forward_window_return", "capex_fy ret_m", f"with {GROWTH}, {window_sql(WS_FWD, '(0),(6),(12)')} select market, anchor, offset_months, {rd('window_return')} as window_return, n from win")
def _(spark, d):
    out = lg.forward_window_return(driver(spark, d), mk.with_returns(fx.prices_m(spark, d)), (0, 6, 12))
    return out.select("market", "anchor", F.col("offset").alias("offset_months"), r("window_return"), "n")


@query("j10_backward_window_return", "capex_fy ret_m", f"with {GROWTH}, {window_sql(WS_BACK, '(3),(6),(12)')} select market, anchor, offset_months, {rd('window_return')} as window_return, n from win")
def _(spark, d):
    out = lg.backward_window_return(driver(spark, d), mk.with_returns(fx.prices_m(spark, d)), (3, 6, 12))
    return out.select("market", "anchor", F.col("offset").alias("offset_months"), r("window_return"), "n")


@query("j12_yoy_exact", "monthly_volume", f"with g as (select y, m, value, first_value(value) over (order by y*12+m range between 12 preceding and 12 preceding) as pv from monthly_volume)"
       f" select last_day(make_date(y, m, 1)) as date, {rd('(value / pv - 1) * 100')} as yoy from g where pv is not null")
def _(spark, d):
    dated = fx.monthly_volume(spark, d).withColumn("date", cal.month_end("y", "m"))
    return gr.yoy_exact(dated).select("date", r("yoy"))


YEARS = ("yr as (select CAST(year(o_orderdate) AS INT) as year, " + fx.s("o_totalprice") + " as value, CAST(count(*) AS DOUBLE) as n from orders group by 1)")


@query("j13_growth_gap", sql=f"with {YEARS}, g as (select year, (value / lag(value) over (order by year) - 1) * 100 as l, (n / lag(n) over (order by year) - 1) * 100 as rr from yr)"
       f" select year, {rd('l')} as left_growth, {rd('rr')} as right_growth, {rd('l - rr')} as gap, CASE WHEN year >= 2000 THEN 'provisional' ELSE 'revised' END as status from g where l is not null")
def _(spark, d):
    yr = fx.table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("int").alias("year")).agg(
        fx.dsum("o_totalprice").alias("value"), F.count(F.lit(1)).cast("double").alias("n"))
    left = yr.select("year", "value", F.when(F.col("year") >= 2000, "provisional").otherwise("actual").alias("status"))
    right = yr.select("year", F.col("n").alias("value"), F.lit("revised").alias("status"))
    return gr.growth_gap(left, right).select("year", r("left_growth"), r("right_growth"), r("gap"), "status")


@query("j14_bridge", "records", "with l as (select date, entity, value from records where indicator='BUILDING'),"
       " rr as (select date, entity, value, status from records where indicator='MACHINERY')"
       f" select entity, date, 'share' as indicator, {rd('value', 4)} as value, 'actual' as status from l union all"
       f" select l.entity, l.date, 'ratio', {rd('l.value / rr.value')}, CASE WHEN rr.status <> 'actual' THEN rr.status ELSE 'actual' END from l join rr on l.date = rr.date and l.entity = rr.entity where rr.value <> 0")
def _(spark, d):
    recs = settle(fx.records(spark, d))
    left = recs.where("indicator = 'BUILDING'").select("entity", "date", F.lit("share").alias("indicator"), "value", F.lit("actual").alias("status"))
    out = vt.bridge(left, recs.where("indicator = 'MACHINERY'"), "ratio", ("entity",))
    return out.select("entity", "date", "indicator", F.when(F.col("indicator") == "share", r("value", 4)).otherwise(r("value", 6)).alias("value"), "status")


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("j15_outer_align", "records", "select entity, date, " + ", ".join(f"max(value) filter (where indicator='{s}') as {s.lower()}" for s in SEGMENTS) + " from records group by 1,2")
def _(spark, d):
    records = settle(fx.records(spark, d))
    return rs.outer_align({s.lower(): records.where(F.col("indicator") == s) for s in SEGMENTS}, ("entity", "date"))


STATUS = "select o_orderpriority as sector, CAST(year(o_orderdate) AS INT) as year, count(*) filter (where o_orderstatus='F') as on_schedule, count(*) filter (where o_orderstatus='O') as delayed, count(*) filter (where o_orderstatus='P') as without_date from orders where year(o_orderdate) < 2001 group by 1,2"
COST = f"select o_orderpriority as sector, CAST(year(o_orderdate) AS INT) as year, {fx.s('o_totalprice')} as original_cost, {fx.xs(fx.PRICE_S + ' * 0.125')} as cost_overrun from orders where year(o_orderdate) > 1996 group by 1,2"


def status_cost(spark, d):
    p = fx.projects(spark, d)
    status = p.where("year < 2001").select("sector", "year", F.lit(None).cast("long").alias("ahead"), "on_schedule",
                                           F.col("delayed_n").alias("delayed"), F.col("undated").alias("without_date"))
    cost = fx.table(spark, d, "orders").where("year(o_orderdate) > 1996").groupBy(
        F.col("o_orderpriority").alias("sector"), F.year("o_orderdate").cast("int").alias("year")
    ).agg(fx.dsum("o_totalprice").alias("original_cost"), fx.xsum(f"{fx.PRICE} * 0.125").alias("cost_overrun"))
    return status, cost.withColumn("anticipated_cost", F.col("original_cost") + F.col("cost_overrun"))


@query("j18_quality_join", sql=f"with a as ({STATUS}), b as ({COST}) select coalesce(a.sector, b.sector) as sector, coalesce(a.year, b.year) as year, on_schedule, delayed, without_date, original_cost from a full outer join b on a.sector=b.sector and a.year=b.year")
def _(spark, d):
    return vt.quality_join(*status_cost(spark, d)).select("sector", "year", "on_schedule", "delayed", "without_date", "original_cost")


@query("a8_delivery_quality", sql=f"with a as ({STATUS}), b as ({COST}), q as (select coalesce(a.sector, b.sector) as sector, coalesce(a.year, b.year) as year, coalesce(on_schedule,0) as s, coalesce(delayed,0) as dl, coalesce(without_date,0) as w, original_cost as oc, cost_overrun as co"
       " from a full outer join b on a.sector=b.sector and a.year=b.year) select sector, year, nullif(s+dl+w, 0) as projects_monitored,"
       f" {rd('s * 100.0 / nullif(s+dl+w, 0)')} as on_schedule_share, {rd('dl * 100.0 / nullif(s+dl+w, 0)')} as delayed_share, {rd('w * 100.0 / nullif(s+dl+w, 0)')} as without_date_share, {rd('co * 100 / oc')} as cost_overrun_pct from q")
def _(spark, d):
    q = sm.delivery_quality(vt.quality_join(*status_cost(spark, d)))
    return q.select("sector", "year", "projects_monitored", r("on_schedule_share"), r("delayed_share"), r("without_date_share"), r("cost_overrun_pct"))


@query("j19_upsert_latest", "flows", "select date, CASE WHEN date >= DATE '1998-01-01' AND category='DII' THEN net * 2 ELSE net END as net, category,"
       " CAST(CASE WHEN date >= DATE '1998-01-01' AND category='DII' THEN 2 ELSE 1 END AS INT) as revision from flows")
def _(spark, d):
    f = fx.flows(spark, d).select("date", "category", "net")
    archive = f.withColumn("revision", F.lit(1))
    batch = f.where("date >= date'1998-01-01' and category = 'DII'").withColumn("net", F.col("net") * 2).withColumn("revision", F.lit(2))
    stale = f.where("date < date'1996-01-01'").withColumn("net", F.lit(0.0)).withColumn("revision", F.lit(0))
    return vt.upsert_latest(archive, batch.unionByName(stale), ("date", "category"), "revision")


@query("j20_prefer_source", "capex_fy snap_y", "select coalesce(c.fy, s.fy) as fy, CASE WHEN c.fy is not null and s.fy >= 1998 THEN s.actual WHEN c.fy is not null THEN c.value ELSE s.actual END as value,"
       " CASE WHEN s.fy >= 1998 THEN 'exact' ELSE 'rounded' END as source from (select * from capex_fy where fy < 2001) c full outer join (select * from snap_y where fy >= 1998) s on c.fy = s.fy")
def _(spark, d):
    base = fx.capex_fy(spark, d).where("fy < 2001").withColumn("source", F.lit("rounded"))
    lines = fx.table(spark, d, "lineitem").groupBy(fx.fy("l_shipdate").alias("fy")).agg(fx.xsum(f"{fx.EXT} * (1 - {fx.DISC})").alias("value"))
    return vt.prefer_source(base, lines.where("fy >= 1998").withColumn("source", F.lit("exact")), ["fy"])


@query("j21_assert_known", "records", "select indicator, count(*) as n from records where indicator not in ('BUILDING','MACHINERY') group by 1")
def _(spark, d):
    defs = fx.table(spark, d, "customer").where("c_mktsegment in ('BUILDING','MACHINERY')").select(F.col("c_mktsegment").alias("key"))
    return rs.assert_known(fx.records(spark, d), defs).groupBy("indicator").agg(F.count(F.lit(1)).alias("n"))


@query("j22_scatter_points", "records", "select x.entity, x.date, x.value as x, y.value as y, z.value as z from records x join records y on x.entity=y.entity and x.date=y.date"
       " left join records z on z.entity=x.entity and z.date=x.date and z.indicator='FURNITURE' where x.indicator='BUILDING' and y.indicator='MACHINERY'")
def _(spark, d):
    return scatter(spark, d)


def scatter(spark, d):
    records = settle(fx.records(spark, d))
    return sm.scatter_points(*[records.where(F.col("indicator") == s) for s in ("BUILDING", "MACHINERY", "FURNITURE")], ("entity", "date"))


@query("j24_convert_currency", "prices_d", "with rt as (select market as currency, arg_max(price, date) as rate from prices_d where market <> 'view' group by 1), v as (select event_id, value, CASE WHEN event_type='click' THEN 'USD' ELSE event_type END as currency from events)"
       f" select event_id, v.currency, {rd('CASE WHEN v.currency = ' + chr(39) + 'USD' + chr(39) + ' THEN value ELSE value / rate END')} as usd from v left join rt on v.currency = rt.currency")
def _(spark, d):
    rates = fx.prices_d(spark, d).where("market <> 'view'").select(F.col("market").alias("currency"), "date", F.col("price").alias("rate"))
    v = fx.table(spark, d, "events").select("event_id", "value", F.when(F.col("event_type") == "click", "USD").otherwise(F.col("event_type")).alias("currency"))
    return vt.convert_currency(v, rates).select("event_id", "currency", r("usd"))


@query("w2_growth_prev_nonnull", "records", "with x as (select date, entity, indicator, CASE WHEN month(date) = 6 THEN NULL ELSE value END as v from records), g as (select *, last_value(v ignore nulls) over (partition by entity, indicator order by date rows between unbounded preceding and 1 preceding) as pv from x)"
       f" select date, entity, indicator, {rd('(v / pv - 1) * 100')} as growth from g")
def _(spark, d):
    gaps = fx.records(spark, d).withColumn("value", F.when(F.month("date") != 6, F.col("value")))
    return gr.growth_prev_nonnull(gaps).select("date", "entity", "indicator", r("growth"))


IDX = "year(date)*12+month(date)"


@query("w3_period_diff", "records", f"with g as (select *, first_value(value) over (partition by entity, indicator order by {IDX} range between 1 preceding and 1 preceding) as pv from records)"
       f" select date, entity, indicator, {rd('value - pv', 4)} as diff, {rd('ln(value) - ln(pv)')} as log_diff from g")
def _(spark, d):
    k = ("entity", "indicator")
    out = gr.period_diff(fx.records(spark, d), "monthly", "value", k)
    out = gr.period_diff(out, "monthly", "value", k, True, "log_diff")
    return out.select("date", "entity", "indicator", r("diff", 4), r("log_diff"))


@query("w5_shift_fiscal_year", "capex_fy", "select make_date(fy + 1, 3, 31) as date, 'public_capex_lagged' as indicator, value, printf('FY%d-%02d', fy, (fy + 1) % 100) as period_label, make_date(fy, 4, 1) as period_start from capex_fy")
def _(spark, d):
    base = fx.capex_fy(spark, d).select(F.make_date("fy", F.lit(3), F.lit(31)).alias("date"), F.lit("capex").alias("indicator"), "value")
    return gr.shift_fiscal_year(base, "public_capex_lagged").select("date", "indicator", "value", "period_label", "period_start")


TR = "(partition by entity, indicator order by date rows 11 preceding)"


@query("w13_trailing_deviation", "records", f"with g as (select *, CASE WHEN count(value) over {TR} = 12 THEN avg(value) over {TR} END as mean from records) select date, entity, indicator, {rd('(value / mean - 1) * 100')} as deviation from g")
def _(spark, d):
    return gr.trailing_deviation(fx.records(spark, d), 12, "value", ("entity", "indicator")).select("date", "entity", "indicator", r("deviation"))


@query("w14_trailing_consecutive_sum", "records", f"with g as (select *, {IDX} as i from records) select date, entity, indicator, {rd(f'CASE WHEN count(*) over {TR} = 12 AND i - min(i) over {TR} = 11 THEN sum(value) over {TR} END', 5)} as trailing_sum from g")
def _(spark, d):
    return gr.trailing_consecutive_sum(fx.records(spark, d), 12, "value", ("entity", "indicator")).select("date", "entity", "indicator", r("trailing_sum", 5))
