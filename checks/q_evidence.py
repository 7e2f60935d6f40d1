"""Alignment, regression, diagnostics and grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.registry import query, r, rd
from tidemark.operators import alignment as al
from tidemark.operators import evidence as ev
from tidemark.operators import filters as fl
from tidemark.operators import regression as rg
from tidemark.session import settle

# --- registered inputs -----------------------------------------------------------

IDX = "(year(date)*12+month(date))"
REASON = "CASE WHEN date < DATE '1995-06-30' THEN 'before_start' WHEN status not in ('actual','provisional') THEN 'status' WHEN value is null THEN 'missing_value' WHEN value <= 0 THEN 'nonpositive_log' END"
# Every nation: missing months and mixed statuses.
ONE = ("one as (select entity, date, CASE WHEN month(date) = 8 THEN NULL WHEN month(date) = 9 THEN -value ELSE value END as value, status from records where indicator='{}')")
BY = ("entity",)


def series(records, indicator):
    v = F.when(F.month("date") == 9, -F.col("value")).when(F.month("date") != 8, F.col("value"))
    return records.where(F.col("indicator") == indicator).withColumn("value", v).select("entity", "date", "value", "status")


LOG = al.InputSpec("building", "monthly", "dependent", ("actual", "provisional"), "log_difference")


@query("f3_eligible_observations", "records", f"with {ONE.format('BUILDING')} select entity, date, status, {REASON} as reason from one")
def _(spark, d):
    return al.eligible_observations(series(fx.records(spark, d), "BUILDING"), LOG, "1995-06-30").select("entity", "date", "status", "reason")




@query("w4_period_lag", "records", f"with k as (select * from records where status = 'actual') select t.entity, t.indicator, t.date, k.value, k.date as source_date from k join records t on t.entity = k.entity and t.indicator = k.indicator and year(t.date)*12+month(t.date) = year(k.date)*12+month(k.date) + 2")
def _(spark, d):
    every = settle(fx.records(spark, d)).withColumn("source_date", F.col("date"))
    out = al.period_lag(every.where("status = 'actual'"), every, 2, "monthly", ("entity", "indicator"))
    return out.where("date is not null").select("entity", "indicator", "date", "value", "source_date")


def prep_sql(name, indicator, transform, lag, statuses):
    """Prepared rows of one input under the alignment rules."""
    ok = f"status in ({statuses}) and value is not null" + (" and value > 0" if transform.startswith("log") else "")
    v = "ln(CASE WHEN value > 0 THEN value END)" if transform.startswith("log") else "value"
    base = f"{name}_k as (select entity, date, {IDX} as i, status, CASE WHEN {ok} THEN {v} END as v, {ok} as ok from one_{name})"
    diff = (f"{name}_d as (select *, v - first_value(v) over (partition by entity order by i range between 1 preceding and 1 preceding) as dv from {name}_k)")
    value = "dv" if transform.endswith("difference") else "v"
    kept = f"{name}_p as (select entity, date, i, status, {value} as v from {name}_d where ok and {value} is not null)"
    if lag:
        out = f"{name} as (select t.entity, t.date, p.v, p.status, p.date as source_date from {name}_p p join {name}_k t on t.entity = p.entity and t.i = p.i + {lag})"
    else:
        out = f"{name} as (select entity, date, v, status, date as source_date from {name}_p)"
    return f"one_{name} as (select entity, date, CASE WHEN month(date) = 8 THEN NULL WHEN month(date) = 9 THEN -value ELSE value END as value, status from records where indicator='{indicator}'), {base}, {diff}, {kept}, {out}"


ST = "'actual','provisional','revised'"
AL3 = ", ".join([prep_sql("a", "BUILDING", "log_difference", 0, "'actual','provisional'"), prep_sql("b", "MACHINERY", "level", 1, ST), prep_sql("c", "FURNITURE", "difference", 0, ST)])
SPECS = (
    al.InputSpec("a", "monthly", "dependent", ("actual", "provisional"), "log_difference"),
    al.InputSpec("b", "monthly", "focal", ("actual", "provisional", "revised"), "level", 1),
    al.InputSpec("c", "monthly", "control", ("actual", "provisional", "revised"), "difference"),
)


def aligned(spark, d):
    records = settle(fx.records(spark, d))
    inputs = {"a": series(records, "BUILDING"), "b": series(records, "MACHINERY"), "c": series(records, "FURNITURE")}
    return al.align(inputs, SPECS, "lag_then_inner_join", by=BY)


@query("j5_align", "records", f"with {AL3} select a.entity, a.date, {rd('a.v')} as a, {rd('b.v', 4)} as b, {rd('c.v', 4)} as c, a.status as a__status, b.status as b__status, b.source_date as b__source_date from a join b using (entity, date) join c using (entity, date)")
def _(spark, d):
    return aligned(spark, d).sample.select("entity", "date", r("a"), r("b", 4), r("c", 4), "a__status", "b__status", "b__source_date")


@query("j5_align_excluded", "records", f"with {AL3}, al as (select entity, date from a join b using (entity, date) join c using (entity, date)),"
       " raw as (select 'a' as input, entity, date, value, status, i, ok, v, v is not null and dv is null as nodiff from (select k.*, o.value, d.dv from a_k k join one_a o using (entity, date) join a_d d using (entity, date))"
       " union all select 'c', entity, date, value, status, i, ok, v, v is not null and dv is null from (select k.*, o.value, d.dv from c_k k join one_c o using (entity, date) join c_d d using (entity, date))"
       " union all select 'b', k.entity, k.date, o.value, k.status, k.i, k.ok, k.v, false from b_k k join one_b o on k.entity=o.entity and k.date=o.date),"
       " rs as (select entity, input, CASE WHEN input='a' and status = 'revised' THEN 'status' WHEN value is null THEN 'missing_value' WHEN input='a' and value <= 0 THEN 'nonpositive_log' WHEN nodiff THEN 'difference_unavailable'"
       " WHEN input='b' and (entity, i + 1) not in (select (entity, i) from b_k) THEN 'lag_unavailable' END as reason from raw"
       " union all select entity, 'a', 'alignment' from a anti join al using (entity, date) union all select entity, 'b', 'alignment' from b anti join al using (entity, date) union all select entity, 'c', 'alignment' from c anti join al using (entity, date))"
       " select entity, input, reason, count(*) as n from rs where reason is not null group by 1,2,3")
def _(spark, d):
    return aligned(spark, d).excluded


# --- least squares per region: intercept, order count, settled share ------------

TERMS = ("intercept", "x1", "x2")


def sums(where: str = "") -> str:
    """Closed-form three-term fit: the adjugate of X'X, per region."""
    return (f"s as (select grp, count(*) as n, sum(x1) as a, sum(x2) as b, sum(x1*x1) as c, sum(x1*x2) as e, sum(x2*x2) as f, sum(y) as p, sum(x1*y) as q, sum(x2*y) as t from regression_w {where} group by 1),"
            " iv as (select *, n*(c*f-e*e) - a*(a*f-e*b) + b*(a*e-c*b) as det from s),"
            " w as (select *, (c*f-e*e)/det as i00, (b*e-a*f)/det as i01, (a*e-b*c)/det as i02, (n*f-b*b)/det as i11, (a*b-n*e)/det as i12, (n*c-a*a)/det as i22 from iv),"
            " be as (select *, i00*p+i01*q+i02*t as b0, i01*p+i11*q+i12*t as b1, i02*p+i12*q+i22*t as b2 from w),"
            f" rs as (select r.grp, r.date, r.y, r.x1, r.x2, y - (b0 + b1*x1 + b2*x2) as u, b0 + b1*x1 + b2*x2 as fitted, i00 + 2*i01*x1 + 2*i02*x2 + i11*x1*x1 + 2*i12*x1*x2 + i22*x2*x2 as h, be.n from regression_w r join be on r.grp = be.grp {where})")


def fit(spark, d):
    # A fit reads its sample twice, so the sample is settled out of the orders.
    return rg.ols(settle(fx.regression_w(spark, d)), "y", TERMS, ("grp",))


@query("a34_ols", "regression_w", f"with {sums()} select grp, CAST(n AS BIGINT) as n, {rd('b0', 5)} as b0, {rd('b1', 5)} as b1, {rd('b2', 5)} as b2 from be")
def _(spark, d):
    g = fit(spark, d).groups
    return g.select("grp", "n", *[r(F.col("beta")[i], 5, f"b{i}") for i in range(3)])


@query("a34_ols_residuals", "regression_w", f"with {sums()} select grp, date, {rd('fitted', 5)} as fitted, {rd('u', 5)} as resid from rs")
def _(spark, d):
    return fit(spark, d).rows.select("grp", "date", r("fitted", 5), r("resid", 5))


def hac_sql(lags: int) -> str:
    h = " + ".join(["0.5 * {g}"] + [f"{1 - l / (lags + 1)} * coalesce(lag({{g}}, {l}) over wd, 0)" for l in range(1, lags + 1)])
    cols = ", ".join(f"{h.format(g=g)} as h{i}" for i, g in enumerate(("u", "u*x1", "u*x2")))
    pairs = ", ".join(f"sum({g} * h{j}) + sum({k} * h{i}) as m{i}{j}" for i, g in enumerate(("u", "u*x1", "u*x2")) for j, k in enumerate(("u", "u*x1", "u*x2")))
    inv = (("i00", "i01", "i02"), ("i01", "i11", "i12"), ("i02", "i12", "i22"))
    var = [" + ".join(f"{inv[t][i]}*m{i}{j}*{inv[t][j]}" for i in range(3) for j in range(3)) for t in range(3)]
    out = " union all ".join(
        f"select grp, '{name}' as term, b{t} as coef, sqrt(({var[t]}) * n / (n - 3)) as se from me" for t, name in enumerate(TERMS))
    return (f"hl as (select *, {cols} from rs window wd as (partition by grp order by date)), mm as (select grp, {pairs} from hl group by 1),"
            f" me as (select be.*, mm.* exclude (grp) from be join mm on be.grp = mm.grp), hc as ({out})")


@query("a35_hac", "regression_w", f"with {sums()}, {hac_sql(3)} select grp, term, {rd('coef', 5)} as coef, {rd('se', 5)} as se, {rd('coef / se', 4)} as t from hc")
def _(spark, d):
    return rg.hac(fit(spark, d), 3).select("grp", "term", r("coef", 5), r("se", 5), r("t", 4))


@query("a35_hac_p_value")
def _(spark, d):
    return rg.hac(fit(spark, d), 2).select("grp", "term", r("p_value", 9), r("ci_low"), r("ci_high"))


@query("a36_design_rank", "regression_w", "select grp, CAST(3 AS INT) as rank, CAST(4 AS INT) as columns, false as full_rank from regression_w group by 1")
def _(spark, d):
    # One column is twice another, so the rank is one short.
    df = fx.regression_w(spark, d).withColumn("twice", F.col("x1") * 2)
    return rg.design_rank(df, ("intercept", "x1", "x2", "twice"), ("grp",))


@query("a37_condition_number", "regression_w", f"with c as (select grp, abs(corr(x1, x2)) as c from regression_w group by 1) select grp, {rd('sqrt((1 + c) / (1 - c))', 5)} as condition from c")
def _(spark, d):
    return rg.condition_number(fx.regression_w(spark, d), ("x1", "x2"), ("grp",)).select("grp", r("condition", 5))


COOK = "ck as (select grp, date, u*u*h / (3 * (sum(u*u) over (partition by grp) / (n - 3)) * (1 - h) * (1 - h)) as d, h from rs)"


@query("a38_cooks", "regression_w", f"with {sums()}, {COOK} select grp, date, {rd('h')} as leverage, {rd('d')} as cooks from ck")
def _(spark, d):
    return rg.cooks(fit(spark, d)).select("grp", "date", r("leverage"), r("cooks"))


@query("a38_max_cooks", "regression_w", f"with {sums()}, {COOK} select grp, {rd('max(d)')} as max_cooks from ck group by 1")
def _(spark, d):
    return rg.max_cooks(fit(spark, d)).select("grp", r("max_cooks"))


@query("f11_drop_most_influential", "regression_w", f"with {sums()}, {COOK}, k as (select *, row_number() over (partition by grp order by d desc, date) as rn from ck) select grp, date from k where rn > 1")
def _(spark, d):
    return fl.drop_most_influential(rg.cooks(fit(spark, d)), ("grp",)).select("grp", "date")


@query("a39_breusch_godfrey")
def _(spark, d):
    return rg.breusch_godfrey(fit(spark, d), 3).select("grp", r("lm"), r("bg_p_value"))


@query("a40_adf_gate")
def _(spark, d):
    return rg.adf_gate(rg.adf(fit(spark, d).rows, by=("grp",))).select("grp", "lag", r("tau"), r("adf_p_value"), "stationary")


ENDS = ("e as (select grp, date, y, x1, row_number() over (partition by grp order by date) as i, count(*) over (partition by grp) as n from regression_w),"
        " sl as (select grp, max(n) as n, regr_slope(y, x1) filter (where i > 12) as s1, regr_slope(y, x1) filter (where i <= n - 12) as s2 from e group by 1)")


@query("a41_stability_gate", "regression_w", f"with {ENDS} select grp, CAST(n AS BIGINT) as n, n > 36 and s1 > 0 and s2 > 0 as stable from sl")
def _(spark, d):
    return rg.stability_gate(settle(fx.regression_w(spark, d)), "y", ("intercept", "x1"), "x1", "positive", by=("grp",))


VARIANT = ("v as (select *, 'full' as variant from regression_w union all select *, 'later' from regression_w where date >= DATE '1997-01-01'"
           " union all select *, 'no_1998' from regression_w where not date between DATE '1998-01-01' and DATE '1998-12-31')")


@query("a42_robustness", "regression_w", f"with {VARIANT} select grp, variant, count(*) as n, {rd('regr_slope(y, x1)', 5)} as slope, CASE WHEN regr_slope(y, x1) > 0 THEN true ELSE false END as same_direction from v group by 1,2")
def _(spark, d):
    base = settle(fx.regression_w(spark, d))
    tagged = base.withColumn("variant", F.lit("full")).unionByName(
        base.where("date >= date'1997-01-01'").withColumn("variant", F.lit("later"))).unionByName(
        fl.exclude_range(base, "1998-01-01", "1998-12-31").withColumn("variant", F.lit("no_1998")))
    g = rg.ols(tagged, "y", ("intercept", "x1"), ("grp", "variant")).groups
    slope = F.col("beta")[1]
    return g.select("grp", "variant", "n", r(slope, 5, "slope"), rg.direction_matches(slope, "positive").alias("same_direction"))


@query("p19_design_columns", "regression_w", "select grp, date, CAST(year(date)*12+month(date) - min(year(date)*12+month(date)) over (partition by grp) AS DOUBLE) as monthly_trend, CASE WHEN month(date)=3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END as month_03,"
       " CASE WHEN date >= DATE '1998-04-01' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END as level_shift, CAST(greatest(0, year(date)*12+month(date) - (1998*12+4)) AS DOUBLE) as slope_shift, CASE WHEN date in (DATE '1997-03-01', DATE '1998-03-01') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END as exceptional from regression_w")
def _(spark, d):
    out = rg.segmented_design(fx.regression_w(spark, d), "1998-04-30", ("grp",))
    out = rg.exceptional_dates(out, ("1997-03-01", "1998-03-01"))
    return out.select("grp", "date", "monthly_trend", "month_03", "level_shift", "slope_shift", "exceptional")


# --- multiple testing, gates and grades over tests derived from the orders -------

# A test per customer: its share of open orders stands in for a p-value.
PV = ("pv as (select c_custkey as analysis_key, c_nationkey as family, CASE WHEN count(o_orderkey) > 3 THEN CAST(count(*) filter (where o_orderstatus='O') AS DOUBLE) / count(*) / 4 END as p_value, c_acctbal / 1000 as value from customer left join orders on c_custkey=o_custkey group by 1,2,c_acctbal)")
BH = ("bh as (select *, least(min(coalesce(p_value, 1) * m / rk) over (partition by family order by coalesce(p_value, 1) desc, analysis_key desc rows unbounded preceding), 1.0) as adjusted_p_value from"
      " (select *, count(*) over (partition by family) as m, row_number() over (partition by family order by coalesce(p_value, 1), analysis_key) as rk from pv))")


def tests(spark, d):
    o = fx.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n"), (F.count_if(F.col("o_orderstatus") == "O").cast("double") / F.count(F.lit(1)) / 4).alias("p"))
    c = fx.table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("analysis_key"), F.col("c_nationkey").alias("family"),
                    F.when(F.col("n") > 3, F.col("p")).alias("p_value"), (F.col("c_acctbal") / 1000).alias("value"))


@query("a50_bh_adjust", sql=f"with {PV}, {BH} select analysis_key, family, {rd('adjusted_p_value')} as adjusted_p_value from bh")
def _(spark, d):
    return ev.bh_adjust(tests(spark, d)).select("analysis_key", "family", r("adjusted_p_value"))


GATE_SQL = ("g as (select grp, count(*) as n, min(date) as start_date, max(date) as end_date, count(*) >= 80 as minimum_observations, count(*) >= 30 as minimum_complete_pairs, count(distinct round(y, 12)) > 1 as dependent_variation,"
            " count(distinct round(x1, 12)) > 1 as focal_variation, count(*) - 3 >= 20 as residual_degrees_of_freedom, grp <> 'ASIA' as no_exact_multicollinearity, true as no_future_information from regression_w group by 1)")


def gates(spark, d):
    df = settle(fx.regression_w(spark, d))
    # In one region the control repeats the focal column.
    df = df.withColumn("x2", F.when(F.col("grp") == "ASIA", F.col("x1")).otherwise(F.col("x2")))
    return ev.eligibility(df, dependent=["y"], focal=["x1"], controls=["x2"], min_observations=80, min_pairs=30, parameters=3, min_residual_df=20, by=("grp",))


OKAY = "minimum_observations and minimum_complete_pairs and dependent_variation and focal_variation and residual_degrees_of_freedom and no_exact_multicollinearity and no_future_information"


@query("r2_eligibility", "regression_w", f"with {GATE_SQL} select *, {OKAY} as eligible, CAST(80 AS INT) as required_observations,"
       f" CASE WHEN {OKAY} THEN 'All registered pre-estimation eligibility gates passed.' ELSE 'Failed registered eligibility gates: ' || concat_ws(', ', CASE WHEN not minimum_observations THEN 'minimum_observations' END, CASE WHEN not no_exact_multicollinearity THEN 'no_exact_multicollinearity' END) || '.' END as reason from g")
def _(spark, d):
    return gates(spark, d)


@query("r3_insufficient", "regression_w", f"with {GATE_SQL} select grp, n, 'insufficient_data' as status, 'not_assessed' as grade from g where not ({OKAY})")
def _(spark, d):
    return ev.insufficient(gates(spark, d)).select("grp", "n", "status", "grade")


@query("r7_readiness", "regression_w", f"with {GATE_SQL}, h as (select date, max(y) filter (where grp='ASIA') as y, max(x1) filter (where grp='EUROPE') as x1 from regression_w group by 1)"
       f" select 'regions' as analysis_key, grp, n, {OKAY} as eligible from g union all select 'cross', 'ALL', count(*), count(*) >= 30 from h where y is not null and x1 is not null")
def _(spark, d):
    cross = settle(fx.regression_w(spark, d)).groupBy("date").agg(
        F.max(F.when(F.col("grp") == "ASIA", F.col("y"))).alias("y"), F.max(F.when(F.col("grp") == "EUROPE", F.col("x1"))).alias("x1")
    ).where("y is not null and x1 is not null")
    second = ev.eligibility(cross, dependent=["y"], focal=["x1"], min_observations=30, min_pairs=30, parameters=2, min_residual_df=20).withColumn("grp", F.lit("ALL"))
    return ev.readiness({"regions": gates(spark, d), "cross": second}).select("analysis_key", "grp", "n", "eligible")


@query("r4_diagnostic_flags", "regression_w", f"with {sums()}, {COOK}, v as (select c.grp, max(d) as d, max(b.n) - 3 as df, max(k.c) as c from ck c join be b on b.grp=c.grp join (select grp, sqrt((1 + abs(corr(x1, x2))) / (1 - abs(corr(x1, x2)))) as c from regression_w group by 1) k on k.grp=c.grp group by 1)"
       f" select grp, 'residual_degrees_of_freedom' as key, {rd('CAST(df AS DOUBLE)', 5)} as value, 20.0::DOUBLE as threshold, df >= 20 as passed from v union all select grp, 'condition_number', {rd('c', 5)}, 30.0::DOUBLE, c <= 30 from v union all select grp, 'influential_observation', {rd('d', 5)}, 1.0::DOUBLE, d <= 1 from v")
def _(spark, d):
    f = fit(spark, d)
    values = f.groups.select("grp", "df", "condition").join(rg.max_cooks(f), "grp")
    return ev.diagnostic_flags(values, 20, ("grp",)).select("grp", "key", r("value", 5), "threshold", "passed")


# Grades per customer: the nation's tests are its robustness checks.
GR = ("fo as (select *, CASE WHEN analysis_key % 3 = 0 THEN 'positive' WHEN analysis_key % 3 = 1 THEN 'negative' ELSE 'two_sided' END as expected from bh),"
      " dg as (select o_custkey as analysis_key, max(CASE WHEN o_totalprice > 490000 THEN 1 ELSE 0 END) = 1 as failed from orders group by 1),"
      " rb as (select o_custkey as analysis_key, (o_totalprice - 150000) / 1000 as value, CASE WHEN o_orderstatus='F' THEN 0.01 ELSE 0.2 END as p from orders),"
      " rj as (select rb.*, CASE expected WHEN 'positive' THEN rb.value > 0 WHEN 'negative' THEN rb.value < 0 ELSE rb.value <> 0 END as ok from rb join fo using (analysis_key)),"
      " ra as (select analysis_key, count(*) as checks, count(*) filter (where ok and p < 0.05) as supported_checks, bool_and(ok) as consistent from rj group by 1),"
      " gj as (select fo.analysis_key, coalesce(adjusted_p_value < 0.1 and CASE expected WHEN 'positive' THEN fo.value > 0 WHEN 'negative' THEN fo.value < 0 ELSE fo.value <> 0 END, false) as main_support, coalesce(failed, false) as failed, coalesce(checks, 0) as checks, coalesce(supported_checks, 0) as supported_checks, coalesce(consistent, true) as consistent from fo left join dg using (analysis_key) left join ra using (analysis_key)),"
      " gs as (select *, CASE WHEN failed THEN 'failed_diagnostics' WHEN main_support THEN CASE WHEN consistent and supported_checks >= ceil(checks / 2.0) THEN 'supported' ELSE 'mixed' END WHEN supported_checks > 0 THEN 'mixed' ELSE 'not_supported' END as status from gj)")


def grade_tables(spark, d):
    k = F.col("analysis_key") % 3
    focal = settle(ev.bh_adjust(tests(spark, d))).withColumn("expected", F.when(k == 0, "positive").when(k == 1, "negative").otherwise("two_sided"))
    o = fx.table(spark, d, "orders").withColumnRenamed("o_custkey", "analysis_key")
    diagnostics = o.select("analysis_key", F.lit("influential_observation").alias("key"), F.col("o_totalprice").cast("double").alias("value"),
                           F.lit(490000.0).alias("threshold"), (F.col("o_totalprice") <= 490000).alias("passed"))
    robust = o.select("analysis_key", F.col("o_orderkey").alias("specification"), ((F.col("o_totalprice") - 150000) / 1000).alias("value"),
                      F.when(F.col("o_orderstatus") == "F", 0.01).otherwise(0.2).alias("p_value"))
    robust = robust.join(focal.select("analysis_key", "expected"), "analysis_key")
    robust = robust.withColumn("status", ev.robustness_status("p_value", "value", F.col("expected"))).drop("expected")
    return focal, diagnostics, robust


def graded(spark, d):
    return ev.grade(*grade_tables(spark, d), 0.1)


@query("r5_grade", sql=f"with {PV}, {BH}, {GR} select analysis_key, main_support, failed, checks, supported_checks, status, CASE WHEN status='supported' and supported_checks = checks THEN 'strong' WHEN status='supported' THEN 'moderate' ELSE 'limited' END as grade from gs")
def _(spark, d):
    return graded(spark, d)


@query("r8_review", "regression_w", f"with {sums()} select grp, {rd('b1', 5)} as published, {rd('b1 + 0.001', 5)} as recomputed from be where grp <> 'EUROPE'")
def _(spark, d):
    g = fit(spark, d).groups.select("grp", F.col("beta")[1].alias("value"))
    off = g.withColumn("value", F.when(F.col("grp") == "EUROPE", F.col("value")).otherwise(F.col("value") + 0.001))
    return ev.review(g, off, ["grp"]).select("grp", r("published", 5), r("recomputed", 5))


@query("r8_rederived_decisions", sql=f"with {PV}, {BH}, {GR}, gd as (select analysis_key, CASE WHEN status='supported' and supported_checks = checks THEN 'strong' WHEN status='supported' THEN 'moderate' ELSE 'limited' END as grade from gs)"
       " select analysis_key, 'grade' as item, CASE WHEN grade='limited' THEN 'strong' ELSE 'limited' END as published, grade as derived from gd where analysis_key % 10 = 0")
def _(spark, d):
    # Every tenth customer's published grade is flipped.
    focal, diagnostics, robust = grade_tables(spark, d)
    robust = settle(robust)  # graded, and reviewed
    flipped = F.when(F.col("analysis_key") % 10 != 0, F.col("grade")).when(F.col("grade") == "limited", "strong").otherwise("limited")
    published = ev.grade(focal, diagnostics, robust, 0.1).withColumn("grade", flipped).join(focal.select("analysis_key", "family", "expected"), "analysis_key")
    estimates = focal.withColumns({"term": F.lit("x"), "is_focal": F.lit(True)})
    return ev.review_decisions(published, estimates, diagnostics, robust, 0.1).select("analysis_key", "item", "published", "derived")
