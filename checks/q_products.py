"""End-to-end products; each composes several operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.q_correlation import COMMON
from checks.q_joins import COST, GROWTH, OUTC, PAIRS, STATUS, VINTAGE, driver, lagcorr_sql, outcomes, status_cost
from checks.q_market import BENCH, MARKETS, PERF, SUMMARY
from checks.q_panel import EST, FE, WITHIN, XY, estimate, sources
from checks.q_summaries import MONTHLY, flows
from checks.registry import corr_sql, query, r, rd
from tidemark.functions import calendar as cal
from tidemark.functions.scalars import status_from_year
from tidemark.operators import alignment as al
from tidemark.operators import quality as ql
from tidemark.operators import rules
from tidemark.plans import evidence_report as er
from tidemark.plans import products as pr

EXECUTION = (VINTAGE + ", gdp as (select CAST(year(o_orderdate) AS INT) as fy, " + fx.s("o_totalprice") + " as g from orders group by 1),"
             " ex as (select make_date(CAST(fy AS INT) + 1, 3, 31) as date, v.*, g from v left join gdp using (fy)), lng as ("
             "select date, 'capex_budget_estimate' as indicator, budget as value, 'budget' as status from ex where budget is not null"
             " union all select date, 'capex_revised_estimate', revised, 'estimate' from ex where revised is not null"
             " union all select date, 'capex_actual', actual, 'actual' from ex where actual is not null"
             " union all select date, 'actual_capex_pct_total_expenditure', actual * 100 / total_expenditure, 'actual' from ex where actual is not null"
             " union all select date, 'actual_capex_pct_gdp', actual * 100 / g, 'provisional' from ex where actual is not null and g > 0"
             " union all select date, 'capex_execution_ratio', actual * 100 / budget, 'actual' from ex where actual is not null and budget is not null"
             " union all select date, 'nominal_capex_growth', (actual / lag(actual) over (order by date) - 1) * 100, 'actual' from ex where actual is not null)")


def execution(spark, d):
    gdp = fx.table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("int").alias("fy")).agg(fx.dsum("o_totalprice").alias("value")).withColumn("status", F.lit("provisional"))
    return pr.execution(fx.snapshots(spark, d), gdp)


@query("e1_execution", "snapshots", f"with {EXECUTION} select date, indicator, {rd('value', 4)} as value, status from lng")
def _(spark, d):
    return execution(spark, d).select("date", "indicator", r("value", 4), "status")


@query("e1_execution_bounds", "snapshots", f"with {EXECUTION} select date, indicator, {rd('value', 4)} as value from lng where indicator = 'actual_capex_pct_gdp' and value > 50")
def _(spark, d):
    limits = spark.createDataFrame([(k, low, 50.0 if k == "actual_capex_pct_gdp" else high) for k, low, high in pr.EXECUTION_BOUNDS], "indicator string, lower double, upper double")
    return ql.check_bounds(execution(spark, d), limits).select("date", "indicator", r("value", 4))


@query("e2_annual_series", "country_year", "select make_date(year, 3, 31) as date, entity as indicator, value, printf('FY%d-%02d', year - 1, year % 100) as period_label from country_year where year > 1996")
def _(spark, d):
    ref = fx.country_year(spark, d).select(F.when(F.col("year") > 1996, "delivery").otherwise("other").alias("dataset"), F.col("entity").alias("series"), F.col("year").alias("fy"), "value", F.lit("actual").alias("status"))
    return pr.annual_series(ref, "delivery").select("date", "indicator", "value", "period_label")


@query("e3_market_summary", "prices_w", f"with {PERF} {SUMMARY}")
def _(spark, d):
    _rows, t = pr.market_performance(fx.prices_w(spark, d), BENCH, MARKETS)
    return t.select("market", *[r(c) for c in t.columns if c not in ("market", "months")], "months")


TARGETS = ("AFRICA", "AMERICA", "EUROPE")
CONTROL = "MIDDLE EAST"
RETS = ("rr as (select market, date, excess as ret from perf where market in ('AFRICA','AMERICA','EUROPE') and excess is not null union all select market, date, ret from perf where market='ASIA' and ret is not null"
        " union all select t.market || '_VS_MIDDLE EAST', t.date, t.ret - c.ret from perf t join perf c on t.date=c.date and c.market='MIDDLE EAST' where t.market in ('AFRICA','AMERICA','EUROPE') and t.ret is not null and c.ret is not null)")
LAGWIN = ("wf as (select market as series, 'capex_leads' as direction, CAST(o AS INT) as lag, 'months' as lag_unit, 'market' as outcome_type, max(driver) as driver, (product(1 + ret) - 1) * 100 as outcome, CAST(year(a.date) AS INT) as year"
          " from drv a cross join (values (0),(6),(12)) s(o) join rr m on m.date > last_day(CAST(a.date + to_months(CAST(o AS INT)) AS DATE)) and m.date <= last_day(CAST(a.date + to_months(CAST(o AS INT) + 12) AS DATE)) where driver is not null group by market, o, a.date having count(*) >= 9),"
          " wb as (select market as series, 'market_leads' as direction, CAST(o AS INT) as lag, 'months' as lag_unit, 'market' as outcome_type, max(driver) as driver, (product(1 + ret) - 1) * 100 as outcome, CAST(year(a.date) AS INT) as year"
          " from drv a cross join (values (3),(6),(12)) s(o) join rr m on m.date > last_day(CAST(a.date - to_months(CAST(o AS INT) + 12) AS DATE)) and m.date <= last_day(CAST(a.date - to_months(CAST(o AS INT)) AS DATE)) where driver is not null group by market, o, a.date having count(*) >= 9),"
          " wy as (select outcome_key as series, 'capex_leads' as direction, lag, 'years' as lag_unit, 'real_economy' as outcome_type, driver, outcome, year from lp where lag < 3),"
          " allp as (select * from wf union all select * from wb union all select * from wy)")
LAGKEYS = "series, direction, lag, lag_unit, outcome_type"
LAGALL = f"{PERF}, {GROWTH}, {OUTC}, {PAIRS}, {RETS}, {LAGWIN}, {lagcorr_sql('allp', LAGKEYS, '2021, 2022')}"


def lag_table(spark, d):
    performance, _summary = pr.market_performance(fx.prices_w(spark, d), BENCH, MARKETS)
    return pr.lag_analysis(driver(spark, d), performance, TARGETS, BENCH, CONTROL, outcomes(spark, d))


@query("e4_lag_analysis", "prices_w capex_fy country_year", f"with {LAGALL} select {LAGKEYS}, {rd('pearson')} as pearson, {rd('spearman')} as spearman, n, CASE WHEN outcome_type='market' THEN {rd('pearson_excluding')} END as pearson_excluding, n_excluding from lc")
def _(spark, d):
    return lag_table(spark, d).select("series", "direction", "lag", "lag_unit", "outcome_type", r("pearson"), r("spearman"), "n", r("pearson_excluding"), "n_excluding")


@query("e5_private_response", "capex_fy", f"with a as (select CAST(year(o_orderdate) AS INT) as fy, {fx.s('o_totalprice')} as g, {fx.xs(f'CASE WHEN o_orderstatus={chr(39)}F{chr(39)} THEN {fx.PRICE_S} ELSE 0 END')} as p, {fx.xs(f'CASE WHEN o_orderstatus<>{chr(39)}O{chr(39)} THEN {fx.PRICE_S} ELSE 0 END')} as t from orders group by 1),"
       f" q as (select CAST(year(o_orderdate) AS INT) as fy, CAST(quarter(o_orderdate) AS INT) as q, CAST(count(*) AS DOUBLE) as cu from orders group by 1,2)"
       f" select make_date(fy+1,3,31) as date, 'private_corporate_gfcf_pct_gdp' as indicator, {rd('p*100/g')} as value, 'revised' as status from a union all select make_date(fy+1,3,31), 'private_share_total_gfcf', {rd('p*100/t')}, 'revised' from a"
       " union all select make_date(fy+1,3,31), 'public_capex_lagged', round(value, 2), 'actual' from capex_fy"
       " union all select last_day(CAST(make_date(fy,4,1) + to_months(3*q-1) AS DATE)), 'manufacturing_capacity_utilisation', cu, 'provisional' from q")
def _(spark, d):
    o = fx.table(spark, d, "orders")
    y = F.year("o_orderdate").cast("int").alias("fy_start")
    accounts = o.groupBy(y).agg(fx.dsum("o_totalprice").alias("nominal_gdp"), fx.xsum(f"case when o_orderstatus = 'F' then {fx.PRICE} else 0 end").alias("private_gfcf"), fx.xsum(f"case when o_orderstatus <> 'O' then {fx.PRICE} else 0 end").alias("total_gfcf"))
    gov = fx.capex_fy(spark, d).select(F.make_date("fy", F.lit(3), F.lit(31)).alias("date"), F.lit("actual_capex_pct_gdp").alias("indicator"), "value", F.lit("actual").alias("status"))
    cu = o.groupBy(y, F.quarter("o_orderdate").cast("int").alias("quarter")).agg(F.count(F.lit(1)).cast("double").alias("cu"))
    out = pr.private_response(accounts, gov, cu)
    small = F.col("indicator").isin("private_corporate_gfcf_pct_gdp", "private_share_total_gfcf")
    return out.select("date", "indicator", F.when(small, r("value")).otherwise(r("value", 2)).alias("value"), "status")


FISC = ("fi as (select make_date(CAST(year(o_orderdate) AS INT) + 1, 3, 31) as date, 'interest_payments_pct_expenditure' as indicator, 100.0 * count(*) filter (where o_orderstatus='F') / count(*) as value, CASE WHEN year(o_orderdate) >= 1999 THEN 'provisional' ELSE 'actual' END as status from orders group by year(o_orderdate))")


@query("e6_fiscal_sustainability", "snapshots", f"with {EXECUTION}, {FISC}, sh as (select date, value, status from lng where indicator='actual_capex_pct_total_expenditure')"
       f" select date, indicator, {rd('value')} as value, status from fi union all select date, 'actual_capex_pct_expenditure', {rd('value')}, status from sh"
       f" union all select sh.date, 'capex_to_interest_allocation_ratio', {rd('sh.value / fi.value')}, CASE WHEN fi.status <> 'actual' THEN fi.status ELSE sh.status END from sh join fi on sh.date=fi.date where fi.value <> 0")
def _(spark, d):
    y = F.year("o_orderdate").cast("int")
    fiscal = fx.table(spark, d, "orders").groupBy(y.alias("y")).agg((F.lit(100.0) * F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("value")).select(
        F.make_date(F.col("y") + 1, F.lit(3), F.lit(31)).alias("date"), F.lit("interest_payments_pct_expenditure").alias("indicator"), "value",
        status_from_year("y", {1999: "provisional"}).alias("status"))
    return pr.fiscal_sustainability(fiscal, execution(spark, d)).select("date", "indicator", r("value"), "status")


FIELDS = ("revenue", "ebitda", "capex", "net_ppe", "debt")


@query("e7_corporate_fundamentals", "fundamentals", " union all ".join(
    f"select grp, fy, '{f}_growth' as metric, {rd('median(x)', 5)} as value from (select grp, fy, ({f} / nullif(lag({f}) over (partition by company_key order by fy), 0) - 1) * 100 as x from fundamentals) where x is not null group by 1,2" for f in FIELDS))
def _(spark, d):
    return pr.corporate_fundamentals(fx.fundamentals(spark, d)).select("grp", "fy", "metric", r("value", 5))


@query("e8_project_quality", sql=f"with a as ({STATUS}), b as ({COST}), q as (select coalesce(a.sector, b.sector) as sector, coalesce(a.year, b.year) as year, coalesce(on_schedule,0)+coalesce(delayed,0)+coalesce(without_date,0) as m, coalesce(delayed,0) as dl, cost_overrun, original_cost from a full outer join b on a.sector=b.sector and a.year=b.year)"
       f" select sector, year, {rd('dl * 100.0 / nullif(m, 0)')} as delayed_share, {rd('cost_overrun * 100 / original_cost')} as cost_overrun_pct from q")
def _(spark, d):
    return pr.project_quality(*status_cost(spark, d)).select("sector", "year", r("delayed_share"), r("cost_overrun_pct"))


@query("e9_state_evaluation", "panel", f"with {XY}, {WITHIN}, {FE} select {EST}, n >= 100 and states >= 15 and years >= 5 as eligible from fe, fy_")
def _(spark, d):
    _panel, table, _medians = pr.state_evaluation(*sources(spark, d), scale=100.0)
    return estimate(table)


CROWD = ("q as (select last_day(make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate)*3 AS INT), 1)) as date, CAST(count(*) AS DOUBLE) as v from orders group by 1),"
         " outc as (select entity as outcome_key, make_date(year, 3, 31) as date, value as outcome from country_year union all"
         " select 'capacity', make_date(CAST(year(date + INTERVAL 9 MONTH) AS INT), 3, 31), avg(v) from q group by 2)")


@query("e10_crowding_in", "capex_fy country_year", f"with {GROWTH}, {CROWD}, {PAIRS}, {lagcorr_sql('lp', 'outcome_key, lag')} select outcome_key, lag, n, {rd('pearson')} as pearson, {rd('spearman')} as spearman, n >= 8 as eligible, CASE WHEN n >= 8 THEN 'associational' ELSE 'insufficient_data' END as status from lc")
def _(spark, d):
    annual = outcomes(spark, d)
    quarters = fx.table(spark, d, "orders").groupBy(cal.quarter_end(F.year("o_orderdate"), F.quarter("o_orderdate")).alias("date")).agg(F.count(F.lit(1)).cast("double").alias("outcome")).withColumn("outcome_key", F.lit("capacity"))
    t = pr.crowding_in(driver(spark, d), annual, quarters)
    return t.select("outcome_key", "lag", "n", r("pearson"), r("spearman"), "eligible", "status")


USABLE = "pearson is not null and n >= 4 and direction = 'capex_leads' and outcome_type = 'market' and series <> 'ASIA'"
ENDS = ("en as (select entity, count(value) as n, arg_min(value, year) as f, arg_max(value, year) as l from country_year group by 1),"
        " sh as (select avg(CASE WHEN pearson > 0 THEN 1.0 ELSE 0.0 END) as s from lc where " + USABLE + ")")


def one(i: int, field: str) -> str:
    return f"(select {field} from en where entity = 'NATION_{i}')"


VERDICT = (f"with {LAGALL}, {ENDS} select 'capex_intensity' as hypothesis, CASE WHEN {one(1, 'n')} >= 2 and {one(2, 'n')} >= 2 and {one(1, 'l')} > {one(1, 'f')} and {one(2, 'l')} > {one(2, 'f')} THEN 'supported' ELSE 'unsupported' END as status"
           " union all select 'sector_transmission', CASE WHEN s >= 2.0/3 THEN 'supported' WHEN s > 0 THEN 'partially_supported' ELSE 'inconclusive' END from sh"
           f" union all select 'real_economy_conversion', CASE WHEN {one(3, 'n')} < 4 or {one(4, 'n')} < 4 THEN 'inconclusive' WHEN {one(3, 'l')} > {one(3, 'f')} and {one(4, 'l')} > {one(4, 'f')} THEN 'supported' ELSE 'partially_supported' END"
           f" union all select 'fiscal_sustainability', CASE WHEN {one(5, 'n')} > 0 and {one(6, 'n')} > 0 THEN 'partially_supported' ELSE 'inconclusive' END")
NAMES = dict(intensity=("NATION_1", "NATION_2"), conversion=("NATION_3", "NATION_4"), fiscal=("NATION_5", "NATION_6"))


def verdict(spark, d, fn):
    recs = fx.country_year(spark, d).select(F.col("entity").alias("indicator"), F.make_date("year", F.lit(3), F.lit(31)).alias("date"), "value")
    return fn(recs, lag_table(spark, d).withColumnRenamed("series", "label"), BENCH, **NAMES)


@query("r1_classify", "prices_w capex_fy country_year", VERDICT)
def _(spark, d):
    return verdict(spark, d, rules.classify)


@query("e11_verdict", "prices_w capex_fy country_year", VERDICT)
def _(spark, d):
    return verdict(spark, d, pr.verdict)


def yearly(spark, d, status=None):
    pred = "o_orderstatus = 'F'" if status else "true"
    return fx.table(spark, d, "orders").where(pred).groupBy(F.year("o_orderdate").cast("int").alias("year")).agg(fx.dsum("o_totalprice").alias("value"))


@query("e12_digital_adoption", "monthly_volume", f"with pop as (select CAST(year(o_orderdate) AS INT) as y, {fx.s('o_totalprice')} as p from orders where o_orderstatus='F' group by 1), g as (select CAST(year(o_orderdate) AS INT) as y, {fx.s('o_totalprice')} as g from orders group by 1),"
       " t as (select *, CASE WHEN count(*) over w = 12 and y*12+m - min(y*12+m) over w = 11 THEN sum(value) over w END as tv from monthly_volume window w as (order by y, m rows 11 preceding))"
       f" select last_day(make_date(t.y, m, 1)) as date, {rd('volume * 1000000.0 / p')} as per_capita_million, {rd('value / volume', 5)} as average_value, {rd('tv * 100 / g')} as value_pct_gdp from t left join pop on t.y=pop.y left join g on t.y=g.y")
def _(spark, d):
    v = fx.monthly_volume(spark, d).withColumnsRenamed({"y": "year", "m": "month"})
    out = pr.digital_adoption(v, yearly(spark, d, "F"), yearly(spark, d))
    return out.select("date", r(F.col("per_capita") * 1e6, 6, "per_capita_million"), r("average_value", 5), r("value_pct_gdp"))


@query("e12_tax_gap", sql=f"with y as (select CAST(year(o_orderdate) AS INT) as year, {fx.s('o_totalprice')} as g, {fx.xs(f'CASE WHEN o_orderstatus={chr(39)}F{chr(39)} THEN {fx.PRICE_S} END')} as t from orders group by 1), q as (select year, (t / lag(t) over w - 1) * 100 - (g / lag(g) over w - 1) * 100 as gap from y window w as (order by year))"
       f" select year, {rd('gap')} as gap, 'provisional' as status from q where gap is not null")
def _(spark, d):
    tax = yearly(spark, d, "F").withColumn("status", F.lit("provisional"))
    return pr.tax_gap(tax, yearly(spark, d).withColumn("status", F.lit("revised"))).select("year", r("gap"), "status")


@query("e13_external_competitiveness", "monthly_volume", f"with m as (select last_day(make_date(y, m, 1)) as date, CAST(volume AS DOUBLE) as v, value from monthly_volume), dv as (select date, (v / CASE WHEN count(v) over w = 60 THEN avg(v) over w END - 1) * 100 as x from m window w as (order by date rows 59 preceding)),"
       " yo as (select date, (value / first_value(value) over (order by year(date)*12+month(date) range between 12 preceding and 12 preceding) - 1) * 100 as x from m)"
       f" select date, 'reer_deviation_pct' as indicator, {rd('x')} as value, CASE WHEN year(date) >= 2024 THEN 'provisional' ELSE 'actual' END as status from dv union all select date, 'non_oil_export_growth', {rd('x')}, 'actual' from yo where x is not null union all select date, 'current_account_pct_gdp', {rd('v * 1e8 / value')}, 'actual' from m")
def _(spark, d):
    m = fx.monthly_volume(spark, d).select(cal.month_end("y", "m").alias("date"), F.col("volume").cast("double").alias("v"), "value")
    out = pr.external_competitiveness(m.select("date", F.col("v").alias("value")), m.select("date", "value"), m.select("date", (F.col("v") * 1e6).alias("value")), m.select("date", "value"))
    return out.select("date", "indicator", r("value"), "status")


@query("e14_flow_resilience", "flows", f"with {MONTHLY}, x as (select *, year(month)*12+month(month) as i from mf) select date, {rd('CASE WHEN count(*) over w = 12 and i - min(i) over w = 11 THEN sum(DII) over w END', 3)} as dii_rolling_12m, {rd('CASE WHEN count(*) over w = 12 and i - min(i) over w = 11 THEN sum(FPI) over w END', 3)} as fpi_rolling_12m,"
       f" {rd('CASE WHEN FPI < 0 THEN greatest(DII, 0) / abs(FPI) END')} as dii_offset_ratio from x window w as (order by i rows 11 preceding)")
def _(spark, d):
    return pr.flow_resilience(flows(spark, d)).select("date", r("dii_rolling_12m", 3), r("fpi_rolling_12m", 3), r("dii_offset_ratio"))


@query("e15_annual_records", "country_year", "select make_date(year+1,3,31) as date, 'tertiary_ger' as indicator, entity, value, printf('AY%d-%02d', year, (year+1)%100) as period_label, make_date(year,4,1) as period_start from country_year"
       " union all select make_date(year,12,31), 'educated_unemployment', entity, value, CAST(year AS VARCHAR), make_date(year,1,1) from country_year")
def _(spark, d):
    cy = fx.country_year(spark, d)
    parts = [pr.annual_records(cy, kind, name, ("entity",)) for kind, name in (("academic", "tertiary_ger"), ("calendar", "educated_unemployment"))]
    return parts[0].unionByName(parts[1]).select("date", "indicator", "entity", "value", "period_label", "period_start")


@query("e16_peer_comparison", "country_year", f"with e as (select distinct entity from country_year), y as (select CAST(unnest(range(1994, 2003)) AS INT) as year), dn as (select e.entity, y.year, value from e cross join y left join country_year c on c.entity=e.entity and c.year=y.year)"
       f" select entity, year, value, {rd('(value / lag(value) over (partition by entity order by year) - 1) * 100')} as growth from dn")
def _(spark, d):
    return pr.peer_comparison(fx.country_year(spark, d), 1994, 2002).select("entity", "year", "value", r("growth"))


ALLPAIRS = COMMON.replace(" and a.market in ('AFRICA','ASIA')", "")


@query("e17_currency_correlation", "prices_w", f"with {ALLPAIRS} select market_a, market_b, {rd(corr_sql('x', 'y'))} as corr, count(*) as n from al group by 1,2")
def _(spark, d):
    out = pr.currency_statistics(spark, fx.prices_w(spark, d), MARKETS, fx.events_w(spark))
    return out["correlation"].select("market_a", "market_b", r("corr"), "n")


@query("e17_currency_rebased", "prices_w", "with ok as (select date from prices_w group by 1 having count(distinct market) = 5)"
       f" select date, market, {rd('price / first_value(price) over (partition by market order by date) * 100')} as rebased from prices_w where date in (select date from ok)")
def _(spark, d):
    out = pr.currency_statistics(spark, fx.prices_w(spark, d), MARKETS, fx.events_w(spark))
    return out["rebased"].select("date", "market", r("rebased"))


def evidence_inputs(spark, d):
    """Monthly national series under the trend analysis; yearly ones are too short."""
    m = fx.monthly_volume(spark, d).select(cal.month_end("y", "m").alias("date"), F.col("volume").cast("double").alias("value"), F.lit("actual").alias("status"))
    f = fx.flows(spark, d).groupBy(F.last_day("date").alias("date")).agg((F.sum("net") / 1e6).alias("net"), (F.sum("buy") / 1e6).alias("buy"), (F.sum("sell") / 1e6).alias("sell")).withColumn("status", F.when(F.year("date") >= 2001, "revised").otherwise("actual"))
    return m, f


TREND = er.EvidenceSpec(
    key="volume-trend", inputs=(al.InputSpec("log_volume", "monthly", "dependent", ("actual",), "log"),), alignment="exact_date_inner_join",
    terms=er.ADOPTION_TREND.terms, focal="monthly_trend", expected="positive", max_lag=12, family="digital", diagnostics=er.TREND_DIAGNOSTICS,
    robustness=("start_date_2018_04", "exclude_pandemic_disruption_months", "linear_level_trend", "hac_max_lags_6"),
    later_start="1996-01-31", disruption=("1998-03-31", "1998-06-30"), min_observations=36, scale="annual_log_percent", break_date="1998-04-30")
FISCAL = er.EvidenceSpec(
    key="flow-change", inputs=(al.InputSpec("net_change", "monthly", "dependent", transform="difference"), al.InputSpec("lagged_buy", "monthly", "focal", lag=1), al.InputSpec("lagged_sell", "monthly", "control", lag=1)),
    alignment="lag_then_inner_join", terms=("intercept", "lagged_buy", "lagged_sell", "trend"), focal="lagged_buy", expected="negative", max_lag=2, family="fiscal",
    diagnostics=er.FISCAL_DIAGNOSTICS, robustness=("actual_status_only", "hac_max_lags_1", "exclude_most_influential", "parsimonious_bivariate"))


def inputs_of(spark, d):
    m, f = evidence_inputs(spark, d)
    flow = {name: f.select("date", F.col(c).alias("value"), "status") for name, c in (("net_change", "net"), ("lagged_buy", "buy"), ("lagged_sell", "sell"))}
    return {"log_volume": m}, flow


@query("e18_evidence_report")
def _(spark, d):
    volume, flow = inputs_of(spark, d)
    t = er.combine([er.run(TREND, volume), er.run(FISCAL, flow)])
    return t.select("analysis_key", "n", "term", r("value"), r("se"), r("p_value", 9), r("adjusted_p_value", 9), "checks", "supported_checks", "status", "grade")


@query("e18_evidence_sample", "flows", "with f as (select last_day(date) as date, CAST(sum(net) AS DOUBLE) / 1e6 as net, sum(buy) / 1e6 as buy from flows group by 1), x as (select date, net - lag(net) over (order by date) as c, lag(buy) over (order by date) as lb from f)"
       f" select count(*) as n, {rd('sum(c)', 4)} as change, {rd('sum(lb)', 4)} as lagged from x where c is not null")
def _(spark, d):
    sample = er.prepare(FISCAL, inputs_of(spark, d)[1]).sample
    return sample.agg(F.count(F.lit(1)).alias("n"), r(F.sum("net_change"), 4, "change"), r(F.sum("lagged_buy"), 4, "lagged"))
