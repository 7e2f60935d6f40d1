"""Scalar functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query, r, rd
from tidemark.functions import calendar as cal
from tidemark.functions import scalars as sc
from tidemark.operators import filters as fl
from tidemark.operators import growth as gr
from tidemark.operators import reshape as rs
from tidemark.sources import documents as dc

NUM = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


@query("p1_clean_double", "cells",
       f"select o_orderkey, {rd(f'CASE WHEN regexp_matches(cell, {chr(39)}{NUM}{chr(39)}) THEN CAST(cell AS DOUBLE) END', 4)} as value from cells"
       .replace("CAST(cell AS DOUBLE)", "TRY_CAST(cell AS DOUBLE)"))
def _(spark, d):
    return fx.cells(spark, d).select("o_orderkey", (sc.clean_double("cell", 4, text=True) + 0.0).alias("value"))


STRIPPED = "replace(trim(cell), ',', '')"


@query("p2_parse_number", "cells",
       f"select o_orderkey, {rd(f'TRY_CAST(CASE WHEN {STRIPPED} LIKE {chr(39)}(%){chr(39)} THEN {chr(39)}-{chr(39)} || {STRIPPED}[2:-2] ELSE {STRIPPED} END AS DOUBLE)', 2)} as value from cells")
def _(spark, d):
    return fx.cells(spark, d).select("o_orderkey", r(sc.parse_number("cell"), 2, "value"))


@query("p3_fiscal_period", sql=f"select distinct CAST(l_shipdate AS DATE) as d, {fx.FY_SHIP} as fy_end,"
       f" printf('FY%d-%02d', {fx.FY_SHIP}-1, {fx.FY_SHIP}%100) as label, make_date({fx.FY_SHIP}-1,4,1) as start_date,"
       f" make_date({fx.FY_SHIP},3,31) as end_date from lineitem")
def _(spark, d):
    s = cal.fy_start("d")
    days = fx.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("d")).distinct()
    return days.select("d", cal.fy_end("d").alias("fy_end"), cal.fy_label(s).alias("label"),
                       cal.fy_start_date(s).alias("start_date"), cal.fy_end_date(s).alias("end_date"))


@query("p4_fiscal_quarter_bounds",
       sql="select distinct CAST(year(o_orderdate) AS INT) as fy, CAST(quarter(o_orderdate) AS INT) as q,"
       " CAST(make_date(CAST(year(o_orderdate) AS INT), 4, 1) + to_months(3 * (CAST(quarter(o_orderdate) AS INT) - 1)) AS DATE) as start_date,"
       " last_day(CAST(make_date(CAST(year(o_orderdate) AS INT), 4, 1) + to_months(3 * CAST(quarter(o_orderdate) AS INT) - 1) AS DATE)) as end_date from orders")
def _(spark, d):
    q = fx.table(spark, d, "orders").select(
        F.year("o_orderdate").cast("int").alias("fy"), F.quarter("o_orderdate").cast("int").alias("q")
    ).distinct()
    return q.select("fy", "q", cal.fiscal_quarter_start("fy", "q").alias("start_date"),
                    cal.fiscal_quarter_end("fy", "q").alias("end_date"))


@query("p5_period_ends", sql="select distinct CAST(year(o_orderdate) AS INT) as y, CAST(month(o_orderdate) AS INT) as m,"
       " last_day(CAST(o_orderdate AS DATE)) as month_end,"
       " last_day(make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate)*3 AS INT), 1)) as quarter_end from orders")
def _(spark, d):
    days = fx.table(spark, d, "orders").select(
        F.year("o_orderdate").cast("int").alias("y"), F.month("o_orderdate").cast("int").alias("m"),
        F.quarter("o_orderdate").cast("int").alias("q"),
    ).distinct()
    return days.select("y", "m", cal.month_end("y", "m").alias("month_end"), cal.quarter_end("y", "q").alias("quarter_end"))


@query("p6_parse_month", sql="select distinct strftime(o_orderdate, '%B %Y') as full_label, strftime(o_orderdate, '%b-%y') as short_label,"
       " last_day(CAST(o_orderdate AS DATE)) as from_full, CASE WHEN year(o_orderdate) >= 2000 THEN last_day(CAST(o_orderdate AS DATE))"
       " ELSE last_day(CAST(o_orderdate + INTERVAL 100 YEAR AS DATE)) END as from_short from orders")
def _(spark, d):
    labels = fx.table(spark, d, "orders").select(
        F.date_format("o_orderdate", "MMMM yyyy").alias("full_label"), F.date_format("o_orderdate", "MMM-yy").alias("short_label")
    ).distinct()
    return labels.select("full_label", "short_label", cal.parse_month("full_label").alias("from_full"),
                         cal.parse_month("short_label").alias("from_short"))


QL = ("(CASE quarter(o_orderdate) WHEN 1 THEN 'January-March ' WHEN 2 THEN 'April-June ' WHEN 3 THEN 'July-September '"
      " ELSE 'October-December ' END || CAST(year(o_orderdate) AS VARCHAR))")


@query("p6_parse_quarter_label", sql=f"select distinct {QL} as label,"
       " last_day(make_date(CAST(year(o_orderdate) AS INT), CAST(quarter(o_orderdate)*3 AS INT), 1)) as quarter_end from orders")
def _(spark, d):
    names = F.array(*[F.lit(n) for n in ("January-March", "April-June", "July-September", "October-December")])
    labels = fx.table(spark, d, "orders").select(
        F.concat_ws(" ", F.element_at(names, F.quarter("o_orderdate")), F.year("o_orderdate").cast("string")).alias("label")
    ).distinct()
    return labels.select("label", cal.parse_quarter_label("label").alias("quarter_end"))


@query("p7_period_index", sql="select distinct CAST(o_orderdate AS DATE) as d, CAST(year(o_orderdate)*12+month(o_orderdate) AS INT) as month_idx,"
       " CAST(year(o_orderdate)*4+quarter(o_orderdate) AS INT) as quarter_idx, CAST(year(o_orderdate) AS INT) as year_idx from orders")
def _(spark, d):
    days = fx.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    return days.select("d", cal.period_index("d", "monthly").alias("month_idx"),
                       cal.period_index("d", "quarterly").alias("quarter_idx"), cal.period_index("d", "annual").alias("year_idx"))


@query("p8_status_rules", "projects",
       "select sector, year, CASE WHEN year >= 2000 THEN 'budget' WHEN year >= 1999 THEN 'revised' ELSE 'actual' END as by_year,"
       " CASE year % 3 WHEN 0 THEN 'actual' WHEN 1 THEN 'revised' ELSE 'budget' END as by_suffix from projects")
def _(spark, d):
    label = F.concat(F.col("year").cast("string"), F.element_at(F.array(F.lit(" (A)"), F.lit(" (RE)"), F.lit(" (BE)")), F.col("year") % 3 + 1))
    return fx.projects(spark, d).select(
        "sector", "year", sc.status_from_year("year", {2000: "budget", 1999: "revised"}).alias("by_year"),
        sc.status_from_suffix(label).alias("by_suffix"),
    )


@query("p9_least_final", "records",
       "with p as (select entity, indicator, date, status, lag(status) over (partition by entity, indicator order by date) as prev from records)"
       " select entity, indicator, date, CASE greatest(CASE status WHEN 'actual' THEN 0 WHEN 'revised' THEN 1 ELSE 2 END,"
       " CASE prev WHEN 'actual' THEN 0 WHEN 'revised' THEN 1 ELSE 2 END) WHEN 0 THEN 'actual' WHEN 1 THEN 'revised' ELSE 'provisional' END as status"
       " from p where prev is not null")
def _(spark, d):
    w = gr.series_window(("entity", "indicator"))
    p = fx.records(spark, d).withColumn("prev", F.lag("status").over(w)).where("prev is not null")
    return p.select("entity", "indicator", "date", sc.least_final("status", "prev").alias("status"))


@query("p10_pct", sql=f"select l_orderkey, l_linenumber, l_partkey, {rd('CASE WHEN l_discount <> 0 THEN l_tax * 100 / l_discount END', 4)} as share from lineitem")
def _(spark, d):
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(sc.pct("l_tax", "l_discount"), 4, "share"))


@query("p11_negate_ratio", "projects",
       f"select sector, year, {rd('-original_cost', 2)} as balance, {rd('original_cost / nullif(anticipated_cost, 0)')} as ratio from projects")
def _(spark, d):
    return fx.projects(spark, d).select("sector", "year", r(sc.negate("original_cost"), 2, "balance"),
                                        r(sc.ratio("original_cost", "anticipated_cost"), 6, "ratio"))


@query("p12_per_capita_ticket", "monthly_volume",
       f"with p as (select count(*) as pop from customer) select y, m, {rd('volume * 1000000.0 / pop', 4)} as per_capita,"
       f" {rd('value * 10000000.0 / (volume * 1000000.0)', 4)} as ticket from monthly_volume, p")
def _(spark, d):
    people = fx.table(spark, d, "customer").select(F.count(F.lit(1))).scalar()
    return fx.monthly_volume(spark, d).select(
        "y", "m", r(sc.per_capita("volume", people, 1e6), 4, "per_capita"),
        r(sc.average_ticket("value", "volume", 1e7, 1e6), 4, "ticket"),
    )


@query("p13_norm_label", sql="select distinct o_orderpriority as raw, lower(trim(regexp_replace(replace(o_orderpriority, '-', '. '), '^\\d+\\.\\s*', ''))) as label from orders")
def _(spark, d):
    raw = fx.table(spark, d, "orders").select(F.col("o_orderpriority").alias("raw")).distinct()
    return raw.select("raw", sc.norm_label(F.replace("raw", F.lit("-"), F.lit(". "))).alias("label"))


@query("p14_map_category", "flows", f"select date, CASE category WHEN 'DII' THEN 'DII' ELSE 'FPI' END as category, net from flows")
def _(spark, d):
    mapped = fx.flows(spark, d).withColumn("category", sc.map_category("category", {"DII": "DII", "FII": "FPI", "FPI": "FPI", "FII/FPI": "FPI"}))
    return mapped.where("category is not null").select("date", "category", "net")


@query("p15_effect_transform", "ret_m",
       f"select market, {rd('100 * (exp(12 * avg(ret) / 10) - 1)')} as annual_pct, {rd('abs(1200 * exp(12 * avg(ret) / 10) * stddev_samp(ret))', 4)} as annual_se,"
       f" {rd('100 * (exp(avg(ret) / 10) - 1)')} as level_pct, {rd('12 * avg(ret) / 10')} as annual_level from ret_m group by 1")
def _(spark, d):
    b = gr.pct_change(fx.prices_m(spark, d)).groupBy("market").agg((F.avg("ret") / 10).alias("b"), F.stddev_samp("ret").alias("se"))
    return b.select("market", r(sc.effect("b", "annual_log_percent"), 6, "annual_pct"),
                    r(sc.effect_error("b", "se", "annual_log_percent"), 4, "annual_se"),
                    r(sc.effect("b", "log_percent"), 6, "level_pct"), r(sc.effect("b", "annual_level"), 6, "annual_level"))


@query("p16_derive_indicator", "records",
       f"select date, entity, 'double_' || indicator as indicator, value * 2 as value, true as is_derived, status from records")
def _(spark, d):
    return rs.derive_indicator(fx.records(spark, d), F.concat(F.lit("double_"), F.col("indicator")), F.col("value") * 2).select("date", "entity", "indicator", "value", "is_derived", "status")


@query("p17_with_definitions", "records",
       f"select date, entity, indicator, value, 'Order value of ' || lower(indicator) as label, 'INR' as unit from records")
def _(spark, d):
    defs = fx.table(spark, d, "customer").select(F.col("c_mktsegment").alias("indicator")).distinct().select(
        "indicator", F.concat(F.lit("Order value of "), F.lower("indicator")).alias("label"), F.lit("INR").alias("unit"))
    return rs.with_definitions(fx.records(spark, d), defs).select("date", "entity", "indicator", "value", "label", "unit")


@query("p18_source_rows", sql="select distinct CASE WHEN n_regionkey = 0 THEN '{\"name\":\"' || n_name || '\"}'"
       " ELSE '{\"name\":\"' || n_name || '\",\"url\":\"u/' || n_name || '\"}' END as source from nation")
def _(spark, d):
    n = fx.table(spark, d, "nation").select(
        F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 0, F.concat(F.lit("u/"), "n_name")).alias("url"),
        F.lit(None).cast("string").alias("retrieved_at"))
    return rs.source_rows(n).distinct()


@query("p20_predict_debt", "monthly_volume",
       f"select y, m, {rd('lag(value) over (order by y, m) * 1.07 / 1.1 - volume', 2)} as predicted from monthly_volume")
def _(spark, d):
    from pyspark.sql import Window as W
    v = fx.monthly_volume(spark, d).withColumn("prev", F.lag("value").over(W.orderBy("y", "m")))
    return v.select("y", "m", r(sc.predict_debt("prev", "volume", 7.0, 10.0), 2, "predicted"))


# --- filters -------------------------------------------------------------------

REC = f"date, entity, indicator, value"


@query("f1_select_records", "records", f"select {REC} from records where indicator in ('BUILDING','MACHINERY') and date >= DATE '1997-04-01'")
def _(spark, d):
    kept = fl.select_records(fx.records(spark, d), ("BUILDING", "MACHINERY"), "1997-04-01")
    return kept.select("date", "entity", "indicator", "value")


@query("f2_slice_dates", "records", f"select {REC} from records where date between DATE '1996-01-01' and DATE '1996-12-31'")
def _(spark, d):
    return fl.slice_dates(fx.records(spark, d), "1996-01-01", "1996-12-31").select("date", "entity", "indicator", "value")


# Every nation in a column; in one year all are null.
@query("f4_drop_all", "country_year", "select y.year, n_name as entity, c.value from (select distinct year from country_year where year <> 1995) y cross join nation left join country_year c on c.year = y.year and c.entity = n_name")
def _(spark, d):
    nations = [f"NATION_{k}" for k in range(25)]
    some = fx.country_year(spark, d).withColumn("value", F.when(F.col("year") != 1995, F.col("value")))
    return fl.drop_all(rs.to_wide(some, nations, "year", "entity"), nations).unpivot("year", nations, "entity", "value")


@query("f6_settled", "records", f"select date, entity, indicator, CASE WHEN date >= DATE '2001-01-01' THEN 'budget' ELSE status END as status from records where date < DATE '2001-01-01'")
def _(spark, d):
    marked = fx.records(spark, d).withColumn("status", F.when(F.col("date") >= F.lit("2001-01-01").cast("date"), "budget").otherwise(F.col("status")))
    return fl.settled(marked).select("date", "entity", "indicator", "status")


@query("f7_gate_min_n", "records", f"select {REC} from records where (entity, indicator) in (select (entity, indicator) from records group by entity, indicator having count(value) >= 62)")
def _(spark, d):
    return fl.gate_min_n(fx.records(spark, d), ("entity", "indicator"), 62).select("date", "entity", "indicator", "value")


@query("f8_finite", sql=f"select l_orderkey, l_linenumber, l_partkey, {rd('CASE WHEN l_tax <> 0 THEN ln(l_tax) END')} as v from lineitem")
def _(spark, d):
    log = F.when(F.col("l_tax") != 0, F.ln("l_tax")).otherwise(F.lit(float("-inf")))
    return fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", r(sc.finite(log), 6, "v"))


@query("f9_exclude_years", "country_year", f"select entity, year, value from country_year where year not in (1997, 1998)")
def _(spark, d):
    return fl.exclude_years(fx.country_year(spark, d), (1997, 1998)).select("entity", "year", "value")


@query("f9_exclude_range", "records", f"select {REC} from records where not date between DATE '1997-03-31' and DATE '1999-06-30'")
def _(spark, d):
    return fl.exclude_range(fx.records(spark, d), "1997-03-31", "1999-06-30").select("date", "entity", "indicator", "value")


@query("f10_all_status", "records",
       "with w as (select date, entity, max(status) filter (where indicator='BUILDING') as a__status, max(status) filter (where indicator='MACHINERY') as b__status"
       " from records group by 1,2) select date, entity from w where a__status='actual' and b__status='actual'")
def _(spark, d):
    wide = fx.records(spark, d).groupBy("date", "entity").agg(
        F.max(F.when(F.col("indicator") == "BUILDING", F.col("status"))).alias("a__status"),
        F.max(F.when(F.col("indicator") == "MACHINERY", F.col("status"))).alias("b__status"))
    return fl.all_status(wide, ["a__status", "b__status"]).select("date", "entity")


# --- labelled text ---------------------------------------------------------------

LABEL_RX = r"(?i)Capital Expenditure(?:\d+|\*+)?\s+([\d,.]+)\s+([\d,.]+)"


@query("s13_extract_labelled_amounts", "text_rows",
       f"select l_orderkey, l_linenumber, CAST(regexp_extract(text, '{LABEL_RX}', 1) AS DOUBLE) as amount, CAST(regexp_extract(text, '{LABEL_RX}', 2) AS DOUBLE) as quantity, shipdate from text_rows")
def _(spark, d):
    out = dc.extract_labelled_amounts(fx.text_rows(spark, d), "text", ("Capital Outlay", "Capital Expenditure"), 2)
    return out.select("l_orderkey", "l_linenumber", F.get("amounts", F.lit(0)).alias("amount"), F.get("amounts", F.lit(1)).alias("quantity"), "shipdate")


DOC = ("(select l_orderkey as doc_id, 'head Statement 7 ' || string_agg('PLFS ' || CAST(1990 + l_linenumber AS VARCHAR) || ' person '"
       " || CAST(CAST(q AS INT) AS VARCHAR) || ' ', '' order by l_linenumber) || 'end of statement tail PLFS 1999 person 5' as text"
       " from (select l_orderkey, l_linenumber, sum(l_quantity) as q from lineitem group by 1,2) group by 1)")


@query("s14_extract_sections", sql="select l_orderkey as doc_id, CAST(1990 + l_linenumber AS VARCHAR) as block,"
       " CAST(sum(l_quantity) AS DOUBLE) as value from lineitem group by 1, 2, l_linenumber")
def _(spark, d):
    lines = fx.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("q"))
    entry = F.concat(F.lit("PLFS "), (F.col("l_linenumber") + 1990).cast("string"), F.lit(" person "), F.col("q").cast("int").cast("string"), F.lit(" "))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("e")))).alias("parts")
    ).select("doc_id", F.concat(F.lit("head Statement 7 "), F.concat_ws("", F.col("parts.e")),
                                F.lit("end of statement tail PLFS 1999 person 5")).alias("text"))
    out = dc.extract_sections(docs, "text", "Statement 7", "end of statement", r"PLFS\s+(\d{4})", r"person\s+([\d.]+)")
    return out.select("doc_id", "block", "value")
