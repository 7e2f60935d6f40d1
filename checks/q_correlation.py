"""Pairwise, ranked and rolling correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import corr_sql, query, r, rd
from tidemark.operators import correlation as co
from tidemark.operators import market as mk

HOME = ("click", "error")
AWAY = ("purchase", "signup", "view")
ALL = HOME + AWAY
DAYS = 10

ALIGNED = ("al as (select a.market as market_a, b.market as market_b, a.date, a.ret as x, b.ret as y from ret_d a join ret_d b on a.date = b.date"
           " where a.ret is not null and b.ret is not null and {})")
MATRIX = ALIGNED.format("a.market in ('click','error') and b.market not in ('click','error')")
UPPER = ALIGNED.format("a.market < b.market")


def returns(spark, d):
    return mk.with_returns(fx.prices_d(spark, d))


def matrix_pairs(spark, d):
    """Two registered markets against all the others."""
    return co.market_pairs(spark, HOME, AWAY)


def pairs(spark, d):
    return co.unordered_pairs(spark, sorted(ALL))


def pearson(spark, d):
    return co.pearson_matrix(returns(spark, d), matrix_pairs(spark, d))


PEARSON = f"pm as (select market_a, market_b, {corr_sql('x', 'y')} as corr, count(*) as n from al group by 1,2)"


@query("j16_market_pairs", "ret_d", f"with {UPPER} select market_a, market_b, date, {rd('x')} as x, {rd('y')} as y from al")
def _(spark, d):
    return co.aligned_pairs(returns(spark, d), pairs(spark, d)).select("market_a", "market_b", "date", r("x"), r("y"))


@query("a20_pearson_matrix", "ret_d", f"with {MATRIX}, {PEARSON} select market_a, market_b, {rd('corr')} as corr, n from pm")
def _(spark, d):
    return pearson(spark, d).select("market_a", "market_b", r("corr"), "n")


RANKED = ("rk as (select market_a, market_b, rank() over (partition by market_a, market_b order by x) + (count(*) over (partition by market_a, market_b, x) - 1) / 2.0 as x,"
          " rank() over (partition by market_a, market_b order by y) + (count(*) over (partition by market_a, market_b, y) - 1) / 2.0 as y from al)")


@query("a21_spearman_matrix", "ret_d", f"with {MATRIX}, {RANKED} select market_a, market_b, {rd(corr_sql('x', 'y'))} as corr, count(*) as n from rk group by 1,2")
def _(spark, d):
    return co.spearman_matrix(returns(spark, d), matrix_pairs(spark, d)).select("market_a", "market_b", r("corr"), "n")


def kendall_sql(source: str) -> str:
    return (f"kt as (select p.market_a, p.market_b, sum(sign(p.x - q.x) * sign(p.y - q.y)) as s, sum(abs(sign(p.x - q.x))) as nx, sum(abs(sign(p.y - q.y))) as ny"
            f" from {source} p join {source} q on p.market_a = q.market_a and p.market_b = q.market_b and p.date < q.date group by 1,2)")


@query("a22_kendall_matrix", "ret_d", f"with {MATRIX}, {kendall_sql('al')}, c as (select market_a, market_b, count(*) as n from al group by 1,2)"
       f" select market_a, market_b, {rd('s / (sqrt(nx) * sqrt(ny))')} as corr, n from kt join c using (market_a, market_b)")
def _(spark, d):
    return co.kendall_matrix(returns(spark, d), matrix_pairs(spark, d)).select("market_a", "market_b", r("corr"), "n")


# Coarse values make most ranks tie.
TIED = ("al as (select a.market as market_a, b.market as market_b, a.date, floor(a.ret * 20) as x, floor(b.ret * 10) as y from ret_w a join ret_w b on a.date = b.date"
        " where a.ret is not null and b.ret is not null and a.market < b.market)")


@query("a22_kendall_with_ties", "ret_w", f"with {TIED}, {kendall_sql('al')}, c as (select market_a, market_b, count(*) as n from al group by 1,2)"
       f" select market_a, market_b, {rd('s / (sqrt(nx) * sqrt(ny))')} as corr, n from kt join c using (market_a, market_b)")
def _(spark, d):
    rets = mk.with_returns(fx.prices_w(spark, d))
    listed = co.unordered_pairs(spark, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))
    aligned = co.aligned_pairs(rets, listed)
    coarse = aligned.withColumns({"x": F.floor(F.col("x") * 20).cast("double"), "y": F.floor(F.col("y") * 10).cast("double")})
    return co.kendall_of(coarse).select("market_a", "market_b", r("corr"), "n")


@query("a23_pairwise_correlations", "ret_w",
       "with al as (select a.market as market_a, b.market as market_b, a.ret as x, b.ret as y from ret_w a join ret_w b on a.date = b.date"
       f" where a.ret is not null and b.ret is not null and a.market < b.market) select market_a, market_b, {rd(corr_sql('x', 'y'))} as corr, count(*) as n from al group by 1,2")
def _(spark, d):
    out = co.pairwise_correlations(mk.with_returns(fx.prices_w(spark, d)))
    return out.select("market_a", "market_b", r("corr"), "n")


COMMON = ("pa as (select a.market as market_a, b.market as market_b, a.date, a.price as px, b.price as py from prices_w a join prices_w b on a.date=b.date"
          " where a.market < b.market and a.market in ('AFRICA','ASIA')),"
          " al as (select * from (select market_a, market_b, date, px / lag(px) over w - 1 as x, py / lag(py) over w - 1 as y from pa"
          " window w as (partition by market_a, market_b order by date)) where x is not null and y is not null)")


def fx_pairs(spark):
    names = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
    return spark.createDataFrame([(a, b) for a in ("AFRICA", "ASIA") for b in names if a < b], co.PAIR_SCHEMA)


@query("a24_fx_equity_correlation", "prices_w", f"with {COMMON} select market_a, market_b, {rd(corr_sql('x', 'y'))} as corr, count(*) as n from al group by 1,2")
def _(spark, d):
    return co.fx_equity_correlation(fx.prices_w(spark, d), fx_pairs(spark)).select("market_a", "market_b", r("corr"), "n")


FRAME = f"(partition by market_a, market_b order by date rows {DAYS - 1} preceding)"
ROLLING = (f"rl as (select * from (select market_a, market_b, date, CASE WHEN count(*) over {FRAME} = {DAYS} THEN {corr_sql('x', 'y', FRAME)} END as corr from al)"
           " where corr is not null)")


def rolling(spark, d):
    return co.rolling_correlation(co.aligned_pairs(returns(spark, d), pairs(spark, d)), DAYS)


@query("w10_rolling_correlation", "ret_d", f"with {UPPER}, {ROLLING} select market_a, market_b, date, {rd('corr')} as corr from rl")
def _(spark, d):
    return rolling(spark, d).select("market_a", "market_b", "date", r("corr"))


@query("w10_rolling_correlation_long", "prices_w", f"with {COMMON}, {ROLLING.replace(str(DAYS - 1) + ' preceding', '59 preceding').replace(f'= {DAYS} ', '= 60 ')} select market_a, market_b, date, {rd('corr')} as corr from rl")
def _(spark, d):
    aligned = co.returns_on_common_dates(fx.prices_w(spark, d), fx_pairs(spark))
    return co.rolling_correlation(aligned, 60).select("market_a", "market_b", "date", r("corr"))


@query("a27_correlation_stability", "ret_d", f"with {UPPER}, {ROLLING} select market_a, market_b, {rd('avg(corr)')} as mean_corr, {rd('stddev_samp(corr)')} as std_corr,"
       f" {rd('min(corr)')} as min_corr, {rd('max(corr)')} as max_corr from rl group by 1,2")
def _(spark, d):
    return co.correlation_stability(rolling(spark, d)).select("market_a", "market_b", r("mean_corr"), r("std_corr"), r("min_corr"), r("max_corr"))


@query("a28_rolling_correlation_volatility", "ret_d", f"with {UPPER}, {ROLLING} select market_a, market_b, {rd('stddev_samp(corr)')} as corr_volatility from rl group by 1,2")
def _(spark, d):
    return co.rolling_correlation_volatility(rolling(spark, d)).select("market_a", "market_b", r("corr_volatility"))


@query("w15_latest_rolling", "ret_d", f"with {UPPER}, {ROLLING} select market_a, market_b, {rd('arg_max(corr, date)')} as latest_corr, max(date) as date from rl group by 1,2")
def _(spark, d):
    return co.latest_rolling(rolling(spark, d)).select("market_a", "market_b", r("latest_corr"), "date")


@query("w16_avg_rank", sql="select distinct l_quantity, l_returnflag, CAST(rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0 AS DOUBLE) as avg_rank from lineitem")
def _(spark, d):
    # The rank of a value is the count below it plus half its own ties: counts
    # per value replace a sort of every row.
    return co.avg_rank_by_value(fx.table(spark, d, "lineitem"), "l_quantity", ("l_returnflag",)).select("l_quantity", "l_returnflag", "avg_rank")


@query("a29_average_correlations", "ret_d", f"with {MATRIX}, {PEARSON} select market_a, {rd('avg(corr)')} as avg_corr from pm group by 1")
def _(spark, d):
    return co.average_correlations(pearson(spark, d)).select("market_a", r("avg_corr"))


@query("a29_average_global_correlations", "ret_d", f"with {MATRIX}, {PEARSON} select market_b, {rd('avg(corr)')} as avg_corr from pm group by 1")
def _(spark, d):
    return co.average_correlations(pearson(spark, d), "market_b").select("market_b", r("avg_corr"))


@query("a30_correlation_spread", "ret_d", f"with {MATRIX}, {PEARSON} select market_a, {rd('max(corr) - min(corr)')} as spread from pm group by 1")
def _(spark, d):
    return co.correlation_spread(pearson(spark, d)).select("market_a", r("spread"))


for key, fn, direction in (("t2_strongest", co.strongest, "desc"), ("t2_weakest", co.weakest, "asc")):
    @query(key, "ret_d", f"with {MATRIX}, {PEARSON}, k as (select *, row_number() over (partition by market_a order by corr {direction}, market_b) as rn from pm)"
           f" select market_a, market_b, {rd('corr')} as corr from k where rn = 1")
    def _(spark, d, fn=fn):
        return fn(pearson(spark, d)).select("market_a", "market_b", r("corr"))

for key, by, other in (("t3_ranked_counterparts", "market_a", "market_b"), ("t3_ranked_by_column", "market_b", "market_a")):
    @query(key, "ret_d", f"with {MATRIX}, {PEARSON} select market_a, market_b, {rd('corr')} as corr,"
           f" CAST(row_number() over (partition by {by} order by corr desc, {other}) AS INT) as rank from pm")
    def _(spark, d, by=by):
        return co.ranked_counterparts(pearson(spark, d), by).select("market_a", "market_b", r("corr"), "rank")
