"""Data-quality rules; the tables hold enough irregular rows to find some."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query, rd
from tidemark.operators import quality as ql


@query("v1_check_unique", sql="select o_custkey, CAST(o_orderdate AS DATE) as day, count(*) as n from orders group by 1,2 having count(*) > 1")
def _(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("day"))
    return ql.check_unique(o, ("o_custkey", "day"))


@query("v2_check_min_rows", sql="select count(*) as n, CAST(1000000000 AS INT) as minimum from lineitem having count(*) < 1000000000")
def _(spark, d):
    return ql.check_min_rows(fx.table(spark, d, "lineitem"), 1000000000)


@query("v3_check_domain", sql="select o_orderpriority, count(*) as n from orders where o_orderpriority not in ('1-URGENT','2-HIGH') group by 1")
def _(spark, d):
    return ql.check_domain(fx.table(spark, d, "orders"), "o_orderpriority", ("1-URGENT", "2-HIGH"))


@query("v4_check_required", sql="select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P' and o_totalprice > 200000)")
def _(spark, d):
    o = fx.table(spark, d, "orders").where("o_orderstatus = 'P'").select(
        F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("value"))
    return ql.check_required(o, fx.table(spark, d, "customer"), "c_custkey")


BOUNDS = "b as (select c_mktsegment as indicator, CASE WHEN c_mktsegment <> 'BUILDING' THEN 60000.0 END as lower, CASE WHEN c_mktsegment <> 'MACHINERY' THEN 450000.0 END as upper from customer group by 1)"


@query("v5_check_bounds", "records", f"with {BOUNDS} select date, entity, indicator, value from records join b using (indicator) where value < lower or value > upper")
def _(spark, d):
    b = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("indicator")).distinct().select(
        "indicator", F.when(F.col("indicator") != "BUILDING", 60000.0).alias("lower"), F.when(F.col("indicator") != "MACHINERY", 450000.0).alias("upper"))
    return ql.check_bounds(fx.records(spark, d), b).select("date", "entity", "indicator", "value")


@query("v6_check_finite", sql="select count(*) as n, l_returnflag from lineitem where l_tax = 0 group by 2")
def _(spark, d):
    logged = fx.table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_tax") != 0, F.ln("l_tax")).otherwise(float("-inf")).alias("value"))
    return ql.check_finite(logged).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("v7_check_coverage", "records", "select entity, min(date) as seen_start, max(date) as seen_end from records group by 1 having min(date) <> DATE '1995-01-31' or max(date) <> DATE '2001-07-31'")
def _(spark, d):
    stated = fx.table(spark, d, "nation").select(F.col("n_name").alias("entity"), F.lit("1995-01-31").cast("date").alias("start_date"), F.lit("2001-07-31").cast("date").alias("end_date"))
    return ql.check_coverage(fx.records(spark, d), stated, "entity").select("entity", "seen_start", "seen_end")


@query("v8_check_ordered", sql="with p as (select o_custkey, o_orderkey, CAST(o_orderdate AS DATE) as date, lag(CAST(o_orderdate AS DATE)) over (partition by o_custkey order by o_orderkey) as previous from orders) select * from p where date <= previous")
def _(spark, d):
    o = fx.table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    return ql.check_ordered(o, ("o_custkey",), "o_orderkey")


@query("v9_check_no_lookahead", sql="select l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) as date, CAST(l_shipdate AS DATE) as s__source_date from lineitem join orders on l_orderkey=o_orderkey where l_shipdate > o_orderdate")
def _(spark, d):
    j = fx.table(spark, d, "lineitem").join(fx.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("o_orderdate").cast("date").alias("date"), F.col("l_shipdate").cast("date").alias("s__source_date"))
    return ql.check_no_lookahead(j, ["s__source_date"])


@query("v10_check_correlation", sql=f"select event_id, {rd('value / 20', 4)} as corr from events where value / 20 > 1 or value / 20 < -1")
def _(spark, d):
    e = fx.table(spark, d, "events").select("event_id", (F.col("value") / 20).alias("corr"))
    return ql.check_correlation(e).select("event_id", F.round("corr", 4).alias("corr"))


@query("v11_check_registry", sql="with a as (select distinct p_brand as k from part where p_size > 48), b as (select distinct p_brand as k from part where p_size = 11) select k as p_brand, 'unknown' as problem from a where k not in (select k from b)"
       " union all select k, 'missing' from b where k not in (select k from a)")
def _(spark, d):
    p = fx.table(spark, d, "part")
    return ql.check_registry(p.where("p_size > 48"), p.where("p_size = 11"), "p_brand")


@query("v12_check_reconcile", "flows", "select date, category, buy, sell, net + 0.03 * (day(date) % 2) as net from flows where abs(buy - sell - (net + 0.03 * (day(date) % 2))) > 0.02")
def _(spark, d):
    f = fx.flows(spark, d).withColumn("net", F.col("net") + F.lit(0.03) * (F.dayofmonth("date") % 2))
    return ql.check_reconcile(f).select("date", "category", "buy", "sell", "net")


@query("v12_check_categories", "flows", "select date, count(distinct category) as n from flows where buy > 0 group by 1 having count(distinct category) < 2")
def _(spark, d):
    return ql.check_categories(fx.flows(spark, d).where("buy > 0"), ("DII", "FII/FPI"))


@query("v13_check_part_whole", "projects", "select sector, year, on_schedule, delayed_n from projects where on_schedule > delayed_n or on_schedule <= 0 or delayed_n <= 0")
def _(spark, d):
    return ql.check_part_whole(fx.projects(spark, d), "on_schedule", "delayed_n").select("sector", "year", "on_schedule", "delayed_n")


@query("v14_check_windows", sql="with e as (select o_custkey as event_id, min(o_orderdate) as s, max(o_orderdate) - INTERVAL 1 DAY as f from orders group by o_custkey, o_orderpriority) select event_id, 'reversed' as problem from e where s > f"
       " union all select event_id, 'duplicate' from e group by event_id having count(*) > 1")
def _(spark, d):
    e = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("event_id"), "o_orderpriority").agg(
        F.min("o_orderdate").alias("start_date"), F.expr("max(o_orderdate) - interval 1 day").alias("end_date"))
    return ql.check_windows(e)


# Result rows out of the orders of each customer, coherent only by chance.
RES = ("res as (select c_custkey as analysis_key, CASE c_nationkey % 5 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_supported' WHEN 2 THEN 'mixed' WHEN 3 THEN 'failed_diagnostics' ELSE 'insufficient_data' END as status,"
       " count(o_orderkey) as n, CAST(min(o_orderdate) AS DATE) as start_date, CAST(max(o_orderdate) AS DATE) as end_date, DATE '1995-02-01' as source_start, DATE '2001-07-01' as source_end, count(o_orderkey) > 8 as eligible,"
       " count(o_orderkey) filter (where o_totalprice > 1000) as available, c_acctbal / 1000 as value, c_acctbal / 1000 - 1 as ci_low, CASE WHEN c_nationkey > 1 THEN 9.0 ELSE c_acctbal / 1000 - 2 END as ci_high, 0.5 as se, CAST(c_custkey % 20 AS DOUBLE) / 100 as p_value,"
       " CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey % 20 AS DOUBLE) / 80 END as adjusted_p_value, c_custkey % 9 = 0 as failed from customer left join orders on c_custkey=o_custkey group by c_custkey, c_nationkey, c_acctbal)")
INF = "status in ('supported','not_supported','mixed','failed_diagnostics')"
SUP = "coalesce(adjusted_p_value < 0.05 and value > 0, false)"
RULES = {
    "interval_reversed": "ci_low > ci_high", "estimate_outside_interval": "not (value between ci_low and ci_high)",
    "adjusted_p_missing": "p_value is not null and adjusted_p_value is null", "sample_dates_half_set": "(start_date is null) <> (end_date is null)",
    "sample_reversed": "start_date > end_date", "sample_outside_sources": "start_date < source_start or end_date > source_end",
    "inference_without_eligibility": f"{INF} and not eligible", "inference_incomplete": "false",
    "supported_contradicts_rule": f"status = 'supported' and (not {SUP} or failed)", "not_supported_contradicts_rule": f"status = 'not_supported' and ({SUP} or failed)",
    "failed_without_diagnostic": "status = 'failed_diagnostics' and not failed", "insufficient_with_estimate": "status = 'insufficient_data' and value is not null",
    "insufficient_but_eligible": "status = 'insufficient_data' and eligible", "count_differs": "n <> available",
}


@query("v15_check_evidence", sql=f"with {RES} " + " union all ".join(f"select analysis_key, '{k}' as problem from res where {v}" for k, v in RULES.items()))
def _(spark, d):
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").alias("start_date"), F.max("o_orderdate").cast("date").alias("end_date"),
        F.count_if(F.col("o_totalprice") > 1000).alias("available"))
    c = fx.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n", "available"])
    k, nk, v = F.col("c_custkey"), F.col("c_nationkey") % 5, F.col("c_acctbal") / 1000
    res = c.select(
        k.alias("analysis_key"),
        F.when(nk == 0, "supported").when(nk == 1, "not_supported").when(nk == 2, "mixed").when(nk == 3, "failed_diagnostics").otherwise("insufficient_data").alias("status"),
        "n", "start_date", "end_date", F.lit("1995-02-01").cast("date").alias("source_start"), F.lit("2001-07-01").cast("date").alias("source_end"),
        (F.col("n") > 8).alias("eligible"), "available", v.alias("value"), (v - 1).alias("ci_low"),
        F.when(F.col("c_nationkey") > 1, 9.0).otherwise(v - 2).alias("ci_high"), F.lit(0.5).alias("se"),
        ((k % 20) / 100).alias("p_value"), F.when(k % 7 != 0, (k % 20) / 80).alias("adjusted_p_value"),
        F.lit(True).alias("is_focal"), F.lit("positive").alias("expected"), (k % 9 == 0).alias("failed"),
    )
    return ql.check_evidence(res).select("analysis_key", "problem")


# An analysis is a customer, its estimates and diagnostics are the customer's orders.
ANALYSES = ("an as (select c_custkey as analysis_key, CASE c_custkey % 6 WHEN 0 THEN 'supported' WHEN 1 THEN 'not_supported' WHEN 2 THEN 'mixed' WHEN 3 THEN 'failed_diagnostics' WHEN 4 THEN 'insufficient_data' ELSE 'descriptive_only' END as status,"
            " CASE WHEN c_nationkey % 2 = 0 THEN 'descriptive' ELSE 'limited' END as grade, count(o_orderkey) as n, CAST(min(o_orderdate) AS DATE) as start_date, CAST(max(o_orderdate) AS DATE) as end_date, DATE '1995-02-01' as source_start, DATE '2001-07-01' as source_end,"
            " count(o_orderkey) > 8 as eligible, count(o_orderkey) filter (where o_totalprice > 1000) as available, CASE c_nationkey % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'two_sided' END as expected from customer left join orders on c_custkey = o_custkey group by c_custkey, c_nationkey),"
            " es as (select o_custkey as analysis_key, o_orderkey as position, o_orderpriority as term, (o_totalprice - 150000) / 1000 as value, CASE WHEN o_orderkey % 30 > 0 THEN (o_totalprice - 150000) / 1000 - 1 END as ci_low, CASE WHEN o_orderkey % 30 > 0 THEN (o_totalprice - 150000) / 1000 + CASE WHEN o_orderkey % 50 = 0 THEN -2 WHEN o_orderkey % 60 = 1 THEN -0.5 ELSE 1 END END as ci_high,"
            " CASE WHEN o_orderkey % 40 > 0 THEN 0.95 END as level, CASE WHEN o_orderkey % 3 > 0 THEN 0.01 END as p, CASE WHEN o_orderkey % 7 > 0 THEN (o_orderkey % 20) / 300.0 END as adj, o_orderpriority in ('1-URGENT', '2-HIGH') as focal from orders),"
            " ef as (select analysis_key, count(*) as n_est, count(*) filter (where focal) as n_focal, bool_or(coalesce(ci_low > ci_high, false)) as reversed, bool_or(coalesce(ci_low <= ci_high and not value between ci_low and ci_high, false)) as outside, bool_or(ci_low is not null and level is null) as no_level, bool_or(ci_low is null and level is not null) as no_interval,"
            " bool_or(focal and p is not null and adj is null) as unadjusted, bool_or(p is not null or adj is not null) as tested, bool_or(focal and (ci_low is null or p is null or adj is null)) as incomplete, coalesce(bool_and(coalesce(adj < 0.05, false)) filter (where focal), false) as small, coalesce(bool_and(coalesce(adj < 0.05 and value > 0, false)) filter (where focal), false) as up, coalesce(bool_and(coalesce(adj < 0.05 and value < 0, false)) filter (where focal), false) as down,"
            " coalesce(list(term order by position) filter (where focal), []) as terms from es group by 1),"
            " df as (select o_custkey as analysis_key, bool_or(o_totalprice >= 400000) as failed, list(o_orderstatus order by o_orderkey) as keys from orders group by 1),"
            " kn as (select an.*, coalesce(n_est, 0) as n_est, coalesce(n_focal, 0) as n_focal, coalesce(reversed, false) as reversed, coalesce(outside, false) as outside, coalesce(no_level, false) as no_level, coalesce(no_interval, false) as no_interval, coalesce(unadjusted, false) as unadjusted, coalesce(tested, false) as tested, coalesce(incomplete, false) as incomplete,"
            " coalesce(terms, []) as terms, coalesce(keys, []) as keys, coalesce(failed, false) as failed, coalesce(CASE expected WHEN 'positive' THEN up WHEN 'negative' THEN down ELSE small END, false) as support from an left join ef using (analysis_key) left join df using (analysis_key))")
ANALYSIS_RULES = {
    "sample_outside_sources": "start_date < source_start or end_date > source_end", "interval_reversed": "reversed", "estimate_outside_interval": "outside", "interval_without_level": "no_level",
    "level_without_interval": "no_interval", "adjusted_p_missing": "unadjusted", "inference_without_eligibility": f"{INF} and not eligible", "inference_without_focal": f"{INF} and n_focal = 0",
    "inference_incomplete": f"{INF} and incomplete", "focal_terms_differ": f"{INF} and terms <> ['1-URGENT', '2-HIGH']", "diagnostics_differ": f"{INF} and keys <> ['F', 'O']",
    "supported_contradicts_rule": "status = 'supported' and (not support or failed)", "not_supported_contradicts_rule": "status = 'not_supported' and (support or failed)",
    "failed_without_diagnostic": "status = 'failed_diagnostics' and not failed", "descriptive_with_p_value": "status = 'descriptive_only' and tested", "descriptive_with_other_grade": "status = 'descriptive_only' and grade <> 'descriptive'",
    "insufficient_with_estimate": "status = 'insufficient_data' and n_est > 0", "insufficient_but_eligible": "status = 'insufficient_data' and eligible", "count_differs": "n <> available",
}


@query("v15_check_analyses", sql=f"with {ANALYSES} " + " union all ".join(f"select analysis_key, '{k}' as problem from kn where {v}" for k, v in ANALYSIS_RULES.items()))
def _(spark, d):
    orders, k, nk = fx.table(spark, d, "orders"), F.col("c_custkey"), F.col("c_nationkey") % 3
    per = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("o_orderdate").cast("date").alias("start_date"), F.max("o_orderdate").cast("date").alias("end_date"),
        F.count_if(F.col("o_totalprice") > 1000).alias("available"))
    statuses = F.array(*[F.lit(x) for x in ("supported", "not_supported", "mixed", "failed_diagnostics", "insufficient_data", "descriptive_only")])
    analyses = fx.table(spark, d, "customer").join(per, k == F.col("o_custkey"), "left").fillna(0, ["n", "available"]).select(
        k.alias("analysis_key"), F.get(statuses, (k % 6).cast("int")).alias("status"), F.when(F.col("c_nationkey") % 2 == 0, "descriptive").otherwise("limited").alias("grade"),
        "n", "start_date", "end_date", F.lit("1995-02-01").cast("date").alias("source_start"), F.lit("2001-07-01").cast("date").alias("source_end"), (F.col("n") > 8).alias("eligible"), "available",
        F.when(nk == 0, "positive").when(nk == 1, "negative").otherwise("two_sided").alias("expected"),
        F.array(F.lit("1-URGENT"), F.lit("2-HIGH")).alias("focal_terms"), F.array(F.lit("F"), F.lit("O")).alias("diagnostic_keys"))
    o, v = F.col("o_orderkey"), (F.col("o_totalprice") - 150000) / 1000
    estimates = orders.select(
        F.col("o_custkey").alias("analysis_key"), o.alias("position"), F.col("o_orderpriority").alias("term"), v.alias("value"), F.when(o % 30 > 0, v - 1).alias("ci_low"),
        F.when(o % 30 > 0, v + F.when(o % 50 == 0, -2.0).when(o % 60 == 1, -0.5).otherwise(1.0)).alias("ci_high"), F.when(o % 40 > 0, 0.95).alias("confidence_level"), F.lit(0.5).alias("se"),
        F.when(o % 3 > 0, 0.01).alias("p_value"), F.when(o % 7 > 0, (o % 20) / 300.0).alias("adjusted_p_value"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_focal"))
    diagnostics = orders.select(F.col("o_custkey").alias("analysis_key"), o.alias("position"), F.col("o_orderstatus").alias("key"), (F.col("o_totalprice") < 400000).alias("passed"))
    return ql.check_analyses(analyses, estimates, diagnostics)


TEXT_PATTERNS = (r"\bcopyright\b", r"\blicen[cs]e", r"\bcauses?\b", r"\bdrives?\b", r"\bpassword\b")


def pattern_sql(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{p}'" for p in patterns) + " END"


@query("v16_check_text", sql=f"select doc_id, {pattern_sql(TEXT_PATTERNS)} as pattern from documents where {pattern_sql(TEXT_PATTERNS)} is not null")
def _(spark, d):
    return ql.check_text(fx.table(spark, d, "documents").select("doc_id", "text"), "text", TEXT_PATTERNS).select("doc_id", "pattern")
