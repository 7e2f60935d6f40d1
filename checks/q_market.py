"""Prices, returns and risk."""

from __future__ import annotations

from checks import fixtures as fx
from checks.registry import query, r, rd
from tidemark.operators import filters as fl
from tidemark.operators import growth as gr
from tidemark.operators import market as mk
from tidemark.sources import landing as ld

MARKETS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
BENCH = "ASIA"
ROWS = "market, date"
RUN = "(partition by market order by date rows unbounded preceding)"


def trail(n: int) -> str:
    return f"(partition by market order by date rows {n - 1} preceding)"


def full(n: int, stat: str, value: str = "ret") -> str:
    return f"CASE WHEN count({value}) over {trail(n)} >= {n} THEN {stat} over {trail(n)} END"


# ticks of the events table: last price per day
@query("s7_daily_last", sql=f"select CAST(ts AS DATE) as date, event_type as market,"
       f" {rd('arg_max(value, ts)')} as price from events where value is not null group by 1,2")
def _(spark, d):
    return ld.daily_last(fx.ticks(spark, d), tie="event_id").select("date", "market", r("price"))


@query("a1_month_last", "prices_w",
       f"select market, max(date) as date, {rd('arg_max(price, date)', 2)} as price from prices_w"
       " group by market, date_trunc('month', date)")
def _(spark, d):
    return mk.month_last(fx.prices_w(spark, d)).select("market", "date", r("price", 2))


@query("f5_common_period", "prices_w",
       f"select p.date, market, {rd('price', 2)} as price from prices_w p where date in"
       " (select date from prices_w group by 1 having count(distinct market) = 5)")
def _(spark, d):
    return fl.common_period(fx.prices_w(spark, d), MARKETS).select("date", "market", r("price", 2))


@query("f4_drop_any", "prices_w",
       f"select p.date, market, {rd('price', 2)} as price from prices_w p where date in (select date from prices_w group by 1"
       " having count(distinct market) = (select count(distinct market) from prices_w))")
def _(spark, d):
    return fl.drop_any(fx.prices_w(spark, d)).select("date", "market", r("price", 2))


@query("w1_pct_change", "ret_w", f"select date, market, {rd('ret')} as ret from ret_w")
def _(spark, d):
    return gr.pct_change(fx.prices_w(spark, d)).select("date", "market", r("ret"))


GRID = ("with cal as (select date, row_number() over (order by date) as pos from (select distinct date from prices_w)),"
        " g as (select p.*, pos from prices_w p join cal using (date)) select date, market,"
        " {} as ret from g")


@query("w1_pct_change_on_grid", "prices_w", GRID.format(rd(
    "price / first_value(price) over (partition by market order by pos range between 1 preceding and 1 preceding) - 1")))
def _(spark, d):
    return gr.pct_change_on_grid(fx.prices_w(spark, d)).select("date", "market", r("ret"))


@query("w6_rebase", "prices_m", f"select date, market, {rd(f'price / first_value(price) over {RUN} * 100')} as rebased from prices_m")
def _(spark, d):
    return mk.rebase(fx.prices_m(spark, d)).select("date", "market", r("rebased"))


@query("w7_drawdown", "prices_m", f"select date, market, {rd(f'price / max(price) over {RUN} - 1')} as drawdown from prices_m")
def _(spark, d):
    return mk.drawdown(fx.prices_m(spark, d)).select("date", "market", r("drawdown"))


BENCHED = (f"bx as (select m.*, max(CASE WHEN market='{BENCH}' THEN ret END) over (partition by date) as b from ret_m m)")
REL = (f"rel as (select *, CASE WHEN market='{BENCH}' THEN 100.0 WHEN (1+ret)/(1+b) IS NOT NULL THEN"
       f" product((1+ret)/(1+b)) over {RUN} * 100 END as relative,"
       f" CASE WHEN market='{BENCH}' THEN 0.0 ELSE ret - b END as excess from bx)")


@query("w8_relative_wealth", "ret_m", f"with {BENCHED}, {REL} select date, market, {rd('relative')} as relative from rel")
def _(spark, d):
    staged = mk.with_returns(fx.prices_m(spark, d))
    return mk.relative_wealth(staged, BENCH).select("date", "market", r("relative"))


@query("w18_excess_return", "ret_m", f"with {BENCHED}, {REL} select date, market, {rd('excess')} as excess from rel")
def _(spark, d):
    return mk.excess_return(mk.with_returns(fx.prices_m(spark, d)), BENCH).select("date", "market", r("excess"))


@query("w9_rolling_sum", "ret_m", f"with {BENCHED}, {REL} select date, market, {rd(full(12, 'sum(excess)', 'excess'))} as rolling_sum from rel")
def _(spark, d):
    staged = mk.excess_return(mk.with_returns(fx.prices_m(spark, d)), BENCH)
    return mk.rolling_sum(staged, "excess", 12).select("date", "market", r("rolling_sum"))


@query("w9_rolling_volatility", "ret_w",
       f"select date, market, {rd(full(20, 'stddev_samp(ret)') + ' * sqrt(252)')} as rolling_volatility from ret_w")
def _(spark, d):
    staged = mk.with_returns(fx.prices_w(spark, d))
    return mk.rolling_volatility(staged, "ret", 20).select("date", "market", r("rolling_volatility"))


@query("w11_rolling_return", "ret_m",
       f"select date, market, {rd(full(12, 'product(1+ret)') + ' - 1')} as rolling_return from ret_m")
def _(spark, d):
    return mk.rolling_return(mk.with_returns(fx.prices_m(spark, d)), "ret", 12).select("date", "market", r("rolling_return"))


@query("w12_rolling_sharpe", "ret_w", f"select date, market, {rd(full(20, 'avg(ret)') + ' * 252 / (' + full(20, 'stddev_samp(ret)') + ' * sqrt(252))')}"
       " as rolling_sharpe from ret_w")
def _(spark, d):
    staged = mk.with_returns(fx.prices_w(spark, d))
    return mk.rolling_sharpe(staged, "ret", 20).select("date", "market", r("rolling_sharpe"))


def by_market(key, name, expr, build, fixtures="ret_m", digits=6, source=None):
    @query(key, fixtures, f"select market, {rd(expr, digits)} as {name} from {source or fixtures} group by 1")
    def _(spark, d):
        return build(fx.prices_m(spark, d)).select("market", r(name, digits))


TOTAL = "arg_max(price, date) / arg_min(price, date)"
by_market("a9_total_return", "total_return", f"{TOTAL} - 1", mk.total_return)
by_market("a10_cagr_rows", "cagr", f"pow({TOTAL}, 252.0 / count(price)) - 1", lambda p: mk.cagr(p, "rows"))
by_market("a10_cagr_rows_floored", "cagr", f"pow({TOTAL}, 1 / greatest(count(price) / 252.0, 1 / 252.0)) - 1",
          lambda p: mk.cagr(p, "rows_floored"))
by_market("a10_cagr_returns", "cagr", f"pow({TOTAL}, 1 / greatest(count(ret) / 12.0, 1 / 12.0)) - 1",
          lambda p: mk.cagr(p, "returns"))
by_market("a11_annual_return", "annual_return", "avg(ret) * 252", lambda p: mk.annual_return(mk.with_returns(p)))
by_market("a12_annual_volatility", "annual_volatility", "stddev_samp(ret) * sqrt(252)",
          lambda p: mk.annual_volatility(mk.with_returns(p)))
by_market("a14_sharpe", "sharpe", "(avg(ret) - 0.05/252) / stddev_samp(ret) * sqrt(252)",
          lambda p: mk.sharpe(mk.with_returns(p), 0.05))
DOWN = ("(CASE WHEN count(CASE WHEN ret < 0 THEN 1 END) = 0 THEN 0.0 ELSE"
        " stddev_samp(CASE WHEN ret < 0 THEN ret END) * sqrt(252) END)")
by_market("a15_downside_volatility", "downside_volatility", DOWN,
          lambda p: mk.downside_volatility(mk.with_returns(p)))
by_market("a16_sortino", "sortino", f"(CASE WHEN {DOWN} = 0 THEN 0.0 ELSE (avg(ret) * 252 - 0.05) / {DOWN} END)",
          lambda p: mk.sortino(mk.with_returns(p), 0.05))
DD = f"dd as (select *, price / max(price) over {RUN} - 1 as dd from ret_m)"


@query("a17_max_drawdown", "ret_m", f"with {DD} select market, {rd('min(dd)')} as max_drawdown from dd group by 1")
def _(spark, d):
    return mk.max_drawdown(fx.prices_m(spark, d)).select("market", r("max_drawdown"))


CALMAR = f"(CASE WHEN abs(min(dd)) = 0 THEN 0.0 ELSE (pow({TOTAL}, 252.0 / count(price)) - 1) / abs(min(dd)) END)"


@query("a18_calmar", "ret_m", f"with {DD} select market, {rd(CALMAR)} as calmar from dd group by 1")
def _(spark, d):
    return mk.calmar(fx.prices_m(spark, d)).select("market", r("calmar"))


@query("f12_downside", "ret_w", f"select date, market, {rd('ret')} as ret from ret_w where ret < 0")
def _(spark, d):
    return fl.downside(mk.with_returns(fx.prices_w(spark, d))).select("date", "market", r("ret"))


COMPLETE = ("ok as (select date from ret_w where ret is not null group by 1 having count(distinct market) ="
            " (select count(distinct market) from ret_w where ret is not null))")


@query("a13_volatility_table", "ret_w",
       f"with {COMPLETE}, v as (select market, stddev_samp(ret) * sqrt(252) * 100 as v from ret_w where ret is not null"
       f" and date in (select date from ok) group by 1) select market, {rd('v')} as volatility_pct from v")
def _(spark, d):
    return mk.volatility_table(fx.prices_w(spark, d)).select("market", r("volatility_pct"))


PERF = (f"mm as (select market, max(date) as date, arg_max(price, date) as price from prices_w where date in (select date from prices_w"
        " group by 1 having count(distinct market) = 5) group by market, date_trunc('month', date)),"
        " mr as (select *, price/lag(price) over (partition by market order by date)-1 as ret from mm),"
        f" bx as (select m.*, max(CASE WHEN market='{BENCH}' THEN ret END) over (partition by date) as b from mr m), {REL},"
        f" perf as (select *, price / first_value(price) over {RUN} * 100 as normalized_value,"
        f" relative / max(relative) over {RUN} - 1 as drawdown, price / max(price) over {RUN} - 1 as pdd,"
        f" {full(12, 'stddev_samp(excess)', 'excess')} * sqrt(12) as rolling_volatility,"
        f" {full(12, 'sum(excess)', 'excess')} as rolling_12m_excess from rel)")


@query("w17_sector_performance", "prices_w", f"with {PERF} select date, market, {rd('price', 2)} as price, {rd('normalized_value', 4)} as normalized_value,"
       f" {rd('relative', 4)} as relative, {rd('excess')} as excess, {rd('ret')} as raw_return, {rd('drawdown')} as drawdown,"
       f" {rd('rolling_volatility')} as rolling_volatility, {rd('rolling_12m_excess')} as rolling_12m_excess from perf")
def _(spark, d):
    p = mk.sector_performance(fx.prices_w(spark, d), BENCH, MARKETS)
    return p.select("date", "market", r("price", 2), r("normalized_value", 4), r("relative", 4), r("excess"),
                    r("raw_return"), r("drawdown"), r("rolling_volatility"), r("rolling_12m_excess"))


SUMMARY = (f"select market, {rd(TOTAL + ' - 1')} as total_return, {rd(f'pow({TOTAL}, 1 / greatest(count(ret) / 12.0, 1 / 12.0)) - 1')} as cagr,"
           f" {rd('stddev_samp(ret) * sqrt(12)')} as annualized_volatility, {rd('avg(ret) / stddev_samp(ret) * sqrt(12)')} as sharpe_ratio,"
           f" {rd('min(pdd)')} as max_drawdown, {rd('arg_max(relative, date) / 100 - 1')} as excess_total_return,"
           f" {rd('min(drawdown)')} as excess_max_drawdown, count(*) as months from perf group by 1")


@query("a19_market_summary", "prices_w", f"with {PERF} {SUMMARY}")
def _(spark, d):
    t = mk.market_summary(mk.sector_performance(fx.prices_w(spark, d), BENCH, MARKETS))
    return t.select("market", *[r(c) for c in t.columns if c not in ("market", "months")], "months")


@query("j17_relative_return", "ret_m",
       "select t.date, 'EUROPE_VS_AFRICA' as market, " + rd("t.ret - c.ret") + " as ret from ret_m t join ret_m c on t.date = c.date"
       " where t.market='EUROPE' and c.market='AFRICA' and t.ret is not null and c.ret is not null")
def _(spark, d):
    staged = mk.with_returns(fx.prices_m(spark, d))
    return mk.relative_return(staged, "EUROPE", "AFRICA").select("date", "market", r("ret"))


RISK = (f"risk as (select market, {TOTAL} - 1 as total_return, pow({TOTAL}, 252.0 / count(price)) - 1 as cagr, avg(ret)*252 as annual_return,"
        f" stddev_samp(ret)*sqrt(252) as annual_volatility, avg(ret)/stddev_samp(ret)*sqrt(252) as sharpe_ratio,"
        f" CASE WHEN {DOWN} = 0 THEN 0.0 ELSE avg(ret) * 252 / {DOWN} END as sortino_ratio,"
        f" min(dd) as max_drawdown, {CALMAR} as calmar_ratio from dd group by 1)")
METRICS = ("total_return", "cagr", "annual_return", "annual_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown", "calmar_ratio")


@query("t4_metric_rankings", "ret_m",
       f"with {DD}, {RISK}, l as (unpivot risk on {', '.join(METRICS)} into name metric value value)"
       f" select market, metric, {rd('value')} as value, CAST(row_number() over (partition by metric order by"
       " CASE WHEN metric='annual_volatility' THEN value ELSE -value END, market) AS INT) as rank from l")
def _(spark, d):
    ranks = mk.metric_rankings(mk.risk_table(fx.prices_m(spark, d)), METRICS)
    return ranks.select("market", "metric", r("value"), "rank")


@query("j11_event_window_change", "prices_d events_w",
       "with ok as (select date from prices_d group by 1 having count(distinct market) = (select count(distinct market) from prices_d))"
       f" select event_id, market, {rd('(arg_max(price, date) / arg_min(price, date) - 1) * 100')} as pct_change, count(*) as n"
       " from prices_d join events_w on date between start_date and end_date where date in (select date from ok) group by 1,2 having count(*) >= 2")
def _(spark, d):
    out = mk.event_window_change(fx.prices_d(spark, d), fx.events_w(spark))
    return out.select("event_id", "market", r("pct_change"), "n")


@query("j23_cross_decomposition", "prices_d",
       "with p as (select a.market as market_a, b.market as market_b, a.date, a.price as x, b.price as y from prices_d a join prices_d b on a.date=b.date"
       " where (a.market, b.market) in (('click','error'),('purchase','view'))) select market_a, market_b, min(date) as start_date, max(date) as end_date,"
       f" {rd('(arg_max(x, date) / arg_min(x, date) - 1) * 100')} as a_pct_change, {rd('(arg_max(y, date) / arg_min(y, date) - 1) * 100')} as b_pct_change"
       " from p group by 1,2 having count(*) >= 2")
def _(spark, d):
    pairs = spark.createDataFrame([("click", "error"), ("purchase", "view")], "market_a string, market_b string")
    out = mk.cross_decomposition(fx.prices_d(spark, d), pairs)
    return out.select("market_a", "market_b", "start_date", "end_date", r("a_pct_change"), r("b_pct_change"))
