"""State-year panel estimates and their views."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query, r, rd
from tidemark.operators import panel as pn
from tidemark.operators import reshape as rs
from tidemark.session import settle

# x and y enter the estimate rounded to 4 digits, as in the published panel.
XY = ("pg as (select state, fy, outlay * 100 / current_value as x, (first_value(constant_value) over (partition by state order by fy range between 1 following and 1 following) / constant_value - 1) * 100 as y from panel),"
      " pn as (select state, fy as year, round(x, 4) as x, round(y, 4) as y from pg where y is not null)")
WITHIN = ("em as (select state, avg(x) as ex, avg(y) as ey from pn group by 1), pm as (select year, avg(x) as px, avg(y) as py from pn group by 1), gm as (select avg(x) as gx, avg(y) as gy from pn),"
          " wi as (select state, year, x - ex - px + gx as xw, y - ey - py + gy as yw from pn join em using (state) join pm using (year), gm)")
FE = ("cl as (select state, sum(xw*yw) as sxy, sum(xw*xw) as sxx, count(*) as c from wi group by 1), to_ as (select sum(sxy) as sxy, sum(sxx) as sxx, sum(c) as n, count(*) as g from cl),"
      " fe as (select to_.sxy / to_.sxx as b, sqrt(max(g) / (max(g) - 1.0) * sum((cl.sxy - to_.sxy / to_.sxx * cl.sxx) * (cl.sxy - to_.sxy / to_.sxx * cl.sxx)) / (to_.sxx * to_.sxx)) as se,"
      " CAST(max(to_.n) AS BIGINT) as n, max(g) as states from cl, to_ group by to_.sxy, to_.sxx),"
      " fy_ as (select count(distinct year) as years from pn)")


def sources(spark, d):
    # The three published tables: one aggregation here, written once.
    p = settle(fx.panel(spark, d))
    current = p.select("state", "fy", F.col("current_value").alias("value"))
    constant = p.select("state", "fy", F.col("constant_value").alias("value"))
    outlay = p.select("state", "fy", F.col("outlay").alias("value"), F.lit("actual").alias("status"))
    return current, constant, outlay


def panel(spark, d):
    return pn.panel_observations(*sources(spark, d), scale=100.0)


@query("j6_panel_join", "panel", "select state, fy, current_value, constant_value, outlay from panel where fy <> 1999")
def _(spark, d):
    current, constant, outlay = sources(spark, d)
    marked = outlay.withColumn("status", F.when(F.col("fy") == 1999, "budget").otherwise("actual"))
    return pn.panel_join(current, constant, marked).select("state", "fy", "current_value", "constant_value", "outlay")


@query("j7_panel_observations", "panel", f"with {XY} select state, year, x, y from pn")
def _(spark, d):
    return panel(spark, d)


@query("a6_panel_medians", "panel", f"with {XY} select year, {rd('median(x)')} as median_x, {rd('median(y)')} as median_y from pn group by 1")
def _(spark, d):
    return pn.panel_medians(panel(spark, d)).select("year", r("median_x"), r("median_y"))


@query("a31_two_way_demean", "panel", f"with {XY}, {WITHIN} select state, year, {rd('xw')} as xw, {rd('yw')} as yw from wi")
def _(spark, d):
    return pn.two_way_demean(panel(spark, d)).select("state", "year", r("xw"), r("yw"))


EST = f"{rd('b')} as coefficient, {rd('se')} as clustered_se, {rd('b - 1.96 * se')} as ci_low, {rd('b + 1.96 * se')} as ci_high, n, states, years"


def estimate(df):
    return df.select(r("coefficient"), r("clustered_se"), r("ci_low"), r("ci_high"), "n", "states", "years",
                     *[c for c in df.columns if c == "eligible"])


@query("a32_two_way_fe", "panel", f"with {XY}, {WITHIN}, {FE} select {EST} from fe, fy_")
def _(spark, d):
    return estimate(pn.two_way_fe(panel(spark, d)))


@query("r6_panel_gate", "panel", f"with {XY}, {WITHIN}, {FE} select {EST}, n >= 100 and states >= 15 and years >= 5 as eligible from fe, fy_")
def _(spark, d):
    return estimate(pn.panel_gate(pn.two_way_fe(panel(spark, d))))


@query("a33_regression_segment", "panel",
       f"with {XY}, s as (select state, count(*) as n, avg(y) - regr_slope(y, x) * avg(x) as a, regr_slope(y, x) as b, min(x) as x0, max(x) as x1 from pn group by 1)"
       f" select state, 'low' as \"end\", {rd('x0', 4)} as x, {rd('a + b * x0')} as y from s where n >= 2 and isfinite(b) union all select state, 'high', {rd('x1', 4)}, {rd('a + b * x1')} from s where n >= 2 and isfinite(b)")
def _(spark, d):
    return pn.regression_segment(panel(spark, d), ("state",)).select("state", "end", r("x", 4), r("y"))


@query("a45_panel_means", "panel", f"with {XY} select {rd('avg(x)')} as mean_x, {rd('avg(y)')} as mean_y, count(*) as n from pn where year = 1998")
def _(spark, d):
    return pn.panel_means(panel(spark, d), year=1998).select(r("mean_x"), r("mean_y"), "n")


@query("a45_padded_domain", "panel", f"with {XY} select {rd('min(x) - (max(x) - min(x)) * 0.05')} as low, {rd('max(x) + (max(x) - min(x)) * 0.05')} as high from pn")
def _(spark, d):
    return pn.padded_domain(panel(spark, d), "x").select(r("low"), r("high"))


@query("u3_distinct_keys", "panel", f"with {XY} select state, min(year) as first_seen from pn group by 1")
def _(spark, d):
    return rs.distinct_keys(panel(spark, d), "state", "year")
