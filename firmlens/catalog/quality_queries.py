"""Audits, gates and replication-table summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog.common import cleaned, da_table, derived, firm_years, firms, samples, table, winsorized
from firmlens.catalog.panel_queries import cols_df, cols_sql, unpivot_sql
from firmlens.catalog.registry import cte, query, r, sql_with
from firmlens.functions.columns import finite, missing, rnd
from firmlens.operators import panel as P
from firmlens.operators import quality as Q
from firmlens.operators import replication as R
from firmlens.operators.joins import planning_grid

AUD = ["ta_scaled", "roa_lag", "cfo_lead_scaled", "sd_rev"]

# Special values are planted by rule so that the audits see NaN and infinities.
cte("planted", "derived", "SELECT industry, company, year, CASE WHEN sales_growth > 3 THEN 'nan'::DOUBLE ELSE ta_scaled END AS ta_scaled, CASE WHEN size > 13 THEN 'inf'::DOUBLE WHEN size < 9.5 THEN '-inf'::DOUBLE ELSE roa_lag END AS roa_lag, cfo_lead_scaled, sd_rev FROM derived")


def planted(spark, d):
    lit = lambda x: F.lit(float(x))
    return derived(spark, d).select(
        "industry", "company", "year", F.when(F.col("sales_growth") > 3, lit("nan")).otherwise(F.col("ta_scaled")).alias("ta_scaled"),
        F.when(F.col("size") > 13, lit("inf")).when(F.col("size") < 9.5, lit("-inf")).otherwise(F.col("roa_lag")).alias("roa_lag"), "cfo_lead_scaled", "sd_rev")


def audit_sql():
    one = lambda c: f"SELECT industry, '{c}' AS variable, true AS column_present, count(*) AS n_rows, count_if({c} IS NULL) AS n_null, count_if(isnan({c})) AS n_nan, count_if({c} = 'inf'::DOUBLE) AS n_pos_inf, count_if({c} = '-inf'::DOUBLE) AS n_neg_inf, count_if({c} IS NULL OR NOT isfinite({c})) AS n_nonfinite, {str(c in ('ta_scaled', 'da_raw')).lower()} AS primary_column FROM planted GROUP BY industry"
    absent = "SELECT industry, 'da_raw', false, count(*), count(*), 0, 0, 0, count(*), true FROM planted GROUP BY industry"
    return " UNION ALL ".join([one(c) for c in AUD] + [absent])


cte("audit", "planted", audit_sql())


def audit(spark, d):
    return Q.column_audit(planted(spark, d), ["industry"], AUD + ["da_raw"], ["ta_scaled", "da_raw"])


@query("qa1_column_audit", sql_with("audit", f"SELECT *, {r('n_nonfinite / n_rows::DOUBLE')} AS share_nonfinite FROM audit"))
def _(spark, d):
    return audit(spark, d).withColumn("share_nonfinite", rnd("share_nonfinite"))


@query("qa2_row_audit", sql_with("planted", "SELECT * FROM (SELECT company, year, CAST(CASE WHEN ta_scaled IS NULL OR NOT isfinite(ta_scaled) THEN 1 ELSE 0 END + CASE WHEN roa_lag IS NULL OR NOT isfinite(roa_lag) THEN 1 ELSE 0 END AS BIGINT) AS n_nonfinite_primary FROM planted) WHERE n_nonfinite_primary > 0"))
def _(spark, d):
    return Q.row_audit(planted(spark, d), ["company", "year"], ["ta_scaled", "roa_lag"])


@query("qa3_finite_gate", sql_with("audit", """
SELECT industry, CASE WHEN bool_or(industry <> 'BUILDING' AND primary_column AND column_present AND n_nonfinite > 0) THEN 'FAIL_NONFINITE_PRIMARY_COLUMNS' WHEN bool_or(industry <> 'BUILDING' AND primary_column AND NOT column_present) THEN 'PASS_WITH_STRUCTURAL_NA_ONLY'
 WHEN bool_or(industry = 'BUILDING' AND primary_column AND column_present AND n_nonfinite > 0) THEN 'WARN_SECONDARY_NONFINITE_ONLY' ELSE 'PASS' END AS gate FROM audit GROUP BY industry"""))
def _(spark, d):
    return Q.finite_gate(audit(spark, d), ["industry"], F.col("industry") != "BUILDING")


@query("qa4_ratio_plausibility", sql_with("derived", f"""
WITH b AS (SELECT *, inv / nullif(cogs, 0) AS ratio FROM derived), a AS (SELECT industry, count(ratio) AS n_finite, avg(CASE WHEN ratio > 5 OR ratio < 0 THEN 1.0::DOUBLE WHEN ratio IS NOT NULL THEN 0 END) AS es, avg(CASE WHEN ratio > 10 OR ratio < 0 THEN 1.0::DOUBLE WHEN ratio IS NOT NULL THEN 0 END) AS vs,
 avg(CASE WHEN operating_cycle IS NULL THEN 1.0::DOUBLE ELSE 0 END) AS ms, quantile_cont(ratio, 0.5) AS rm, quantile_cont(ratio, 0.99) AS r99, quantile_cont(inv, 0.5) AS nm, quantile_cont(cogs, 0.5) AS dm FROM b GROUP BY industry)
SELECT industry, n_finite, {r('es')} AS extreme_share, {r('vs')} AS very_extreme_share, {r('ms')} AS missing_share, {r('rm')} AS ratio_median, {r('r99')} AS ratio_p99,
 CASE WHEN n_finite < 100 OR rm > 2 OR dm < nm THEN 'REVIEW_REQUIRED' WHEN es > 0.05 OR vs > 0.02 OR r99 > 10 OR ms > 0.5 THEN 'PASS_MAIN_SECONDARY_REVIEW' ELSE 'PASS' END AS status,
 concat_ws('; ', CASE WHEN n_finite < 100 THEN 'too few finite ratios' END, CASE WHEN rm > 2 THEN 'median ratio above 2' END, CASE WHEN dm < nm THEN 'median denominator below median numerator' END, CASE WHEN es > 0.05 THEN 'more than 5% beyond 5 or negative' END,
  CASE WHEN vs > 0.02 THEN 'more than 2% beyond 10 or negative' END, CASE WHEN r99 > 10 THEN '99th percentile above 10' END, CASE WHEN ms > 0.5 THEN 'dependent variable mostly missing' END) AS reasons FROM a"""))
def _(spark, d):
    out = Q.ratio_plausibility(derived(spark, d), ["industry"], "inv", "cogs", "operating_cycle")
    return out.select("industry", "n_finite", *cols_df(["extreme_share", "very_extreme_share", "missing_share", "ratio_median", "ratio_p99"]), "status", "reasons")


@query("qa5_lost_only_because", sql_with("derived", "SELECT count(*) AS n_others_complete, count_if(operating_cycle IS NULL OR sd_rev IS NULL) AS n_lost FROM derived WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in P.CORE_EX_POST)))
def _(spark, d):
    df = derived(spark, d).withColumn("both", F.when(F.col("sd_rev").isNotNull(), F.col("operating_cycle")))
    return Q.lost_only_because_of(df, P.CORE_EX_POST, "both")


@query("qa6_sample_change", sql_with("derived samples", f"""
SELECT coalesce(b.year, a.year) AS year, coalesce(nb, 0) AS n_before, coalesce(na, 0) AS n_after, coalesce(na, 0) - coalesce(nb, 0) AS difference, {r('CASE WHEN nb > 0 THEN 100 * (coalesce(na, 0) - nb) / nb::DOUBLE END')} AS pct_change
FROM (SELECT year, count(*) AS nb FROM derived GROUP BY year) b FULL JOIN (SELECT year, count(*) AS na FROM samples WHERE sample = 'ex_post' GROUP BY year) a ON a.year = b.year"""))
def _(spark, d):
    return Q.count_change(derived(spark, d), samples(spark, d, ["ex_post"]), ["year"]).withColumn("pct_change", rnd("pct_change"))


@query("qa7_provenance", sql_with("cleaned", """
WITH m AS (SELECT CAST(c_custkey AS VARCHAR) AS company, n_name AS exchange FROM customer JOIN nation ON c_nationkey = n_nationkey), p AS (SELECT company, count(*) AS n FROM cleaned GROUP BY company)
SELECT exchange, count(*) AS n_keys, count(n) AS n_keys_with_facts, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_facts, count_if(regexp_matches(exchange, 'NATION_1|ANIA')) AS n_keyword_hits, exchange IN ('NATION_1', 'NATION_2') AS allowed FROM m LEFT JOIN p USING (company) GROUP BY exchange"""))
def _(spark, d):
    return Q.provenance(cleaned(spark, d), firms(spark, d).select("company", "exchange"), "company", "exchange", ["NATION_1", "NATION_2"], "NATION_1|ANIA")


REP_KEYS = "l_linenumber AS t, CAST(floor(l_discount * 25) AS INTEGER) AS sigma, CAST(l_suppkey % 30 AS INTEGER) AS replication, CASE WHEN l_orderkey % 2 = 0 THEN 'row' ELSE 'grouped' END AS validation_target"
cte("rep", "", f"SELECT {REP_KEYS}, avg(l_tax) AS score_pooled, avg(l_quantity) / 50 AS score_firmre FROM lineitem GROUP BY ALL")
cte("rep_rows", "", f"SELECT {REP_KEYS}, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")


def _rep_keys(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        F.col("l_linenumber").alias("t"), F.floor(F.col("l_discount") * 25).cast("int").alias("sigma"), (F.col("l_suppkey") % 30).cast("int").alias("replication"),
        F.when(F.col("l_orderkey") % 2 == 0, "row").otherwise("grouped").alias("validation_target"), "l_linestatus", "l_tax", "l_quantity")


def rep(spark, d):
    """Replication results: per design cell, replication and validation target, from the line items."""
    return _rep_keys(spark, d).groupBy("t", "sigma", "replication", "validation_target").agg(
        F.avg("l_tax").alias("score_pooled"), (F.avg("l_quantity") / 50).alias("score_firmre"))


def rep_rows(spark, d):
    return _rep_keys(spark, d).groupBy("t", "sigma", "replication", "validation_target", "l_linestatus").agg(F.count("*").alias("n"))


def manifest(spark, d):
    return _rep_keys(spark, d).select("t", "sigma").distinct().select("t", "sigma", F.lit(1).alias("rep_start"), F.lit(30).alias("rep_end"))


COMPLETE_SQL = """g AS (SELECT t, sigma, replication, count(*) AS rws, count(DISTINCT validation_target) AS sides FROM rep_rows GROUP BY ALL), w AS (SELECT t, sigma, replication, 1 AS e FROM (SELECT DISTINCT t, sigma FROM rep_rows), (SELECT unnest(range(1, 31))::INTEGER AS replication)),
cov AS (SELECT t, sigma, count(e) AS expected_replications, count(rws) AS observed_replications, CAST(coalesce(sum(rws), 0) AS BIGINT) AS observed_rows, count_if(e IS NOT NULL AND rws IS NULL) AS n_missing, count_if(e IS NULL) AS n_extra, CAST(coalesce(sum(rws - sides), 0) AS BIGINT) AS n_duplicates,
 count_if(rws IS NOT NULL AND sides <> 2) AS n_unpaired FROM w FULL JOIN g USING (t, sigma, replication) GROUP BY t, sigma)"""


@query("qa8_design_completeness", sql_with("rep_rows", f"WITH {COMPLETE_SQL} SELECT *, n_missing = 0 AND n_extra = 0 AND n_duplicates = 0 AND n_unpaired = 0 AS complete FROM cov"))
def _(spark, d):
    return Q.design_completeness(manifest(spark, d), rep_rows(spark, d), ["t", "sigma"], ["row", "grouped"])


@query("qa9_task_blockers", """
SELECT s_nationkey, s_name AS task_key, CASE WHEN s_acctbal < 0 THEN 'FAILED' ELSE 'MISSING' END AS status, count(*) OVER (PARTITION BY s_nationkey) AS n_blocking FROM supplier WHERE s_acctbal < 0 OR s_suppkey % 17 = 0""")
def _(spark, d):
    t = table(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("task_key"), F.when(F.col("s_acctbal") < 0, "FAILED").when(F.col("s_suppkey") % 17 == 0, F.lit(None)).otherwise("SUCCESS").alias("status"))
    return Q.blockers(t, ["s_nationkey"])


@query("qa10_quantity_suppression", """
WITH q AS (SELECT p_brand AS quantity, count(*) > 3 AS required FROM part WHERE p_size < 30 GROUP BY p_brand), v AS (SELECT p_brand AS quantity, min(p_retailprice) < 1000 AS verified FROM part WHERE p_size > 40 GROUP BY p_brand)
SELECT quantity, required, coalesce(verified, false) AS verified, CASE WHEN NOT required THEN 'not_required' WHEN coalesce(verified, false) THEN 'reported' ELSE 'suppressed' END AS report_status FROM q LEFT JOIN v USING (quantity)""")
def _(spark, d):
    p = table(spark, d, "part")
    q = p.filter("p_size < 30").groupBy(F.col("p_brand").alias("quantity")).agg((F.count("*") > 3).alias("required"))
    v = p.filter("p_size > 40").groupBy(F.col("p_brand").alias("quantity")).agg((F.min("p_retailprice") < 1000).alias("verified"))
    return Q.suppression(q, v, "quantity")


@query("qa11_identical_outcomes", sql_with("derived", " UNION ALL ".join(
    f"SELECT '{a}' AS outcome_1, '{b}' AS outcome_2, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n_joint, {r(f'max(abs({a} - {b}))')} AS max_abs_difference, max(abs({a} - {b})) <= 1e-12 AS identical FROM derived"
    for a, b in (("sales_growth", "revenue_growth"), ("sales_growth", "roa_curr"), ("revenue_growth", "roa_curr")))))
def _(spark, d):
    return Q.identical_outcomes(derived(spark, d), ["sales_growth", "revenue_growth", "roa_curr"]).withColumn("max_abs_difference", rnd("max_abs_difference"))


@query("qa12_extraction_guardrail", sql_with("samples", """
WITH c AS (SELECT sample, industry, year, CASE WHEN count(*) >= 30 THEN 'fit_ok' ELSE 'insufficient' END AS model_status, regr_slope(ta_scaled, cfo_curr_scaled) AS estimate FROM samples GROUP BY ALL)
SELECT sample, count_if(model_status = 'fit_ok') AS n_fit_ok, count_if(model_status = 'fit_ok' AND isfinite(estimate)) AS n_finite, count_if(model_status = 'fit_ok') = 0 OR count_if(model_status = 'fit_ok' AND isfinite(estimate)) >= 0.5 * count_if(model_status = 'fit_ok') AS guardrail_pass FROM c GROUP BY sample"""))
def _(spark, d):
    c = samples(spark, d).groupBy("sample", "industry", "year").agg(
        F.when(F.count("*") >= 30, "fit_ok").otherwise("insufficient").alias("model_status"), F.regr_slope("ta_scaled", "cfo_curr_scaled").alias("estimate"))
    return Q.extraction_guardrail(c, ["sample"])


@query("qa13_checklist", sql_with("derived winsorized da", """
SELECT 1 AS check_id, 'unique firm-years' AS check_name, CASE WHEN count(*) = count(DISTINCT (company, year)) THEN 'PASS' ELSE 'FAIL' END AS status, 'rows ' || count(*) AS detail FROM derived
UNION ALL SELECT 2, 'winsorized rows kept', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, 'rows ' || count(*) FROM winsorized UNION ALL SELECT 3, 'positive predictive sd', CASE WHEN count_if(nda_sd_predict <= 0) = 0 THEN 'PASS' ELSE 'FAIL' END, 'bad ' || count_if(nda_sd_predict <= 0) FROM da"""))
def _(spark, d):
    say = lambda n, c: F.concat(F.lit(n + " "), c.cast("string")).alias("detail")
    dv = derived(spark, d)
    dup = dv.groupBy("company", "year").agg(F.count("*").alias("c")).agg((F.max("c") == 1).alias("ok"), say("rows", F.sum("c")))
    w = winsorized(spark, d).agg((F.count("*") > 0).alias("ok"), say("rows", F.count("*")))
    neg = F.count_if(F.col("nda_sd_predict") <= 0)
    return Q.checklist([(1, "unique firm-years", dup), (2, "winsorized rows kept", w), (3, "positive predictive sd", da_table(spark, d).agg((neg == 0).alias("ok"), say("bad", neg)))])


cte("cell_status", "derived", "SELECT industry, year, CASE WHEN count(ta_scaled) / count(*)::DOUBLE < 0.3 THEN 'FAIL' WHEN count(ta_scaled) / count(*)::DOUBLE < 0.5 THEN 'WARN' ELSE 'PASS' END AS status FROM derived GROUP BY ALL")


def cell_status(spark, d):
    s = F.count("ta_scaled") / F.count("*")
    return derived(spark, d).groupBy("industry", "year").agg(F.when(s < 0.3, "FAIL").when(s < 0.5, "WARN").otherwise("PASS").alias("status"))


@query("qa14_decision_rollup", sql_with("cell_status", "SELECT year, count(*) AS n_rows, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS overall FROM cell_status GROUP BY year"))
def _(spark, d):
    return Q.roll_up(cell_status(spark, d), ["year"])


@query("qa15_best_profile", """
WITH x AS (SELECT o_orderpriority AS k, CAST(o_custkey % 7 AS VARCHAR) AS profile, CAST(round(avg(o_totalprice), 2) AS DOUBLE) AS cost, CASE o_custkey % 7 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'FAIL' ELSE 'REVIEW' END AS status FROM orders GROUP BY o_orderpriority, o_custkey % 7)
SELECT k, arg_min(profile, (CASE WHEN status = 'PASS' THEN 0 ELSE 1 END, CAST(profile = '0' AS INTEGER), cost, profile)) AS best_profile, count(*) AS n_acceptable FROM x WHERE status IN ('PASS', 'REVIEW') GROUP BY k""")
def _(spark, d):
    p = (F.col("o_custkey") % 7).cast("string").alias("profile")
    x = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k"), p).agg(F.round(F.avg("o_totalprice"), 2).alias("cost"))
    x = x.withColumn("status", F.when(F.col("profile").isin("0", "1"), "PASS").when(F.col("profile") == "2", "FAIL").otherwise("REVIEW"))
    return Q.best_profile(x, ["k"], "status", ["cost"], F.col("profile") == "0")


@query("qa16_minimum_eligibility", sql_with("samples", """
WITH c AS (SELECT sample, industry, count(DISTINCT year) AS n FROM samples WHERE ta_scaled > 2 GROUP BY ALL)
SELECT g.sample, g.industry, coalesce(n, 0) AS n_eligible, coalesce(n, 0) >= 2 AS eligible FROM (SELECT * FROM (SELECT DISTINCT sample FROM samples) CROSS JOIN (SELECT DISTINCT industry FROM samples)) g LEFT JOIN c ON c.sample = g.sample AND c.industry = g.industry"""))
def _(spark, d):
    s = samples(spark, d)
    grid = planning_grid(s.select("sample").distinct(), s.select("industry").distinct())
    c = s.filter("ta_scaled > 2").groupBy("sample", "industry").agg(F.count_distinct("year").alias("n_eligible"))
    return Q.minimum_eligibility(grid, c, ["sample", "industry"])


MV = ["ta_scaled", "roa_lag", "size"]


LPD = "-0.5::DOUBLE * ln(2 * pi()) - ln(nda_sd_predict) - 0.5 * pow((ta_scaled - nda_mean) / nda_sd_predict, 2)"


@query("qa17_drift_check", sql_with("samples da", f"""
WITH l AS {unpivot_sql('samples', 'sample, industry', MV)}, m AS (SELECT sample, industry, variable, avg(x) AS v FROM l GROUP BY ALL),
t AS (SELECT sample, industry, sum({LPD}) AS total FROM da WHERE scheme = 'row' AND nda_sd_predict > 0 GROUP BY ALL),
c AS (SELECT industry, count(*) AS n_matched, max(abs(a.v - b.v)) AS mx FROM (SELECT * FROM m WHERE sample = 'ex_post') a JOIN (SELECT * FROM m WHERE sample = 'real_time') b USING (industry, variable) GROUP BY industry),
s AS (SELECT c.*, y.total - x.total AS sh FROM c LEFT JOIN (SELECT * FROM t WHERE sample = 'ex_post') x USING (industry) LEFT JOIN (SELECT * FROM t WHERE sample = 'real_time') y USING (industry))
SELECT industry, n_matched, {r('mx')} AS max_abs_difference, {r('sh', 4)} AS total_shift, coalesce(abs(sh) >= 10, true) AS shift_blocked, mx >= 0.005 OR coalesce(abs(sh) >= 10, true) AS blocked FROM s"""))
def _(spark, d):
    from firmlens.functions.columns import normal_log_density
    from firmlens.operators.ordered import unpivot

    m = unpivot(samples(spark, d), ["sample", "industry"], MV).groupBy("sample", "industry", "variable").agg(F.avg("x").alias("v"))
    a = m.filter("sample = 'ex_post'").withColumn("variable", F.regexp_replace(F.upper("variable"), "_", "."))
    held = da_table(spark, d).filter("scheme = 'row' AND nda_sd_predict > 0").groupBy("sample", "industry").agg(F.sum(normal_log_density("ta_scaled", "nda_mean", "nda_sd_predict")).alias("total"))
    totals = tuple(held.filter(F.col("sample") == s).drop("sample") for s in ("ex_post", "real_time"))
    out = Q.drift_check(a, m.filter("sample = 'real_time'"), ["industry"], "variable", "v", totals=totals)
    return out.withColumns({"max_abs_difference": rnd("max_abs_difference"), "total_shift": rnd("total_shift", 4)})


@query("qa18_status_counts", sql_with("cell_status", "SELECT 'cells' AS stage, status, count(*) AS n FROM cell_status GROUP BY status"))
def _(spark, d):
    return Q.status_counts(cell_status(spark, d), "cells", "status")


# --- replication tables ---------------------------------------------------------------------------------------

cte("premium", "rep", """SELECT *, premium_a - premium_b AS premium FROM (SELECT t, sigma, replication, max(CASE WHEN validation_target = 'row' THEN score_firmre - score_pooled END) AS premium_a,
 max(CASE WHEN validation_target = 'grouped' THEN score_firmre - score_pooled END) AS premium_b FROM rep GROUP BY ALL)""")
cte("cells", "premium", """SELECT t, sigma, count(*) AS n, avg(premium) AS mean, stddev_samp(premium) AS sd, avg(CASE WHEN premium > 0 THEN 1.0::DOUBLE ELSE 0 END) AS share_positive, quantile_cont(premium, 0.05) AS p05, quantile_cont(premium, 0.5) AS median, quantile_cont(premium, 0.95) AS p95 FROM premium WHERE premium IS NOT NULL GROUP BY t, sigma""")
SUMMARY = ["mean", "sd", "share_positive", "p05", "median", "p95"]


def cells(spark, d):
    return R.premium_summary(R.premium(rep(spark, d), ["t", "sigma"]), ["t", "sigma"])


@query("rep1_premium_summary", sql_with("cells", f"SELECT t, sigma, n, {cols_sql(SUMMARY)} FROM cells"))
def _(spark, d):
    return cells(spark, d).select("t", "sigma", "n", *cols_df(SUMMARY))


@query("rep2_premium", sql_with("premium", f"SELECT t, sigma, replication, {cols_sql(['premium_a', 'premium_b', 'premium'])} FROM premium"))
def _(spark, d):
    return R.premium(rep(spark, d), ["t", "sigma"]).select("t", "sigma", "replication", *cols_df(["premium_a", "premium_b", "premium"]))


@query("rep3_trend_decision", sql_with("cells", f"""
SELECT sigma, n, {r('s')} AS slope, CASE WHEN s IS NULL THEN 'insufficient_variation' WHEN abs(s) > 0.05 THEN 'material_trend' WHEN abs(s) <= 0.02 THEN 'no_trend' ELSE 'mixed' END AS decision FROM (SELECT sigma, count(*) AS n, CASE WHEN min(t) < max(t) THEN regr_slope(mean, t) END AS s FROM cells GROUP BY sigma)"""))
def _(spark, d):
    return R.trend(cells(spark, d), "t", ["sigma"]).withColumn("slope", rnd("slope"))


@query("rep4_pilot_decision", sql_with("cells", f"""
WITH a AS (SELECT avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS x FROM (SELECT sigma, bool_and(coalesce(dx >= -0.02, true)) AS ok FROM (SELECT sigma, mean - lag(mean) OVER (PARTITION BY sigma ORDER BY t) AS dx FROM cells) GROUP BY sigma)),
b AS (SELECT avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0 END) AS y FROM (SELECT t, bool_and(coalesce(dx >= -0.02, true)) AS ok FROM (SELECT t, mean - lag(mean) OVER (PARTITION BY t ORDER BY sigma) AS dx FROM cells) GROUP BY t)),
c AS (SELECT max(CASE WHEN t = (SELECT max(t) FROM cells) AND sigma = (SELECT max(sigma) FROM cells) THEN mean END) - max(CASE WHEN t = (SELECT min(t) FROM cells) AND sigma = (SELECT min(sigma) FROM cells) THEN mean END) AS h,
 max(CASE WHEN t = (SELECT max(t) FROM cells) AND sigma = (SELECT max(sigma) FROM cells) THEN share_positive END) AS p FROM cells)
SELECT {r('h')} AS high_minus_low, {r('p')} AS high_prob_positive, {r('x')} AS monotone_t_rate, {r('y')} AS monotone_sigma_rate, CASE WHEN x >= 2.0 / 3 AND y >= 2.0 / 3 AND h > 0.1 AND p >= 0.7 THEN 'PILOT_PASS__RUN_FULL_GRID' ELSE 'PILOT_STOP__DO_NOT_RUN_FULL_SIMULATION' END AS decision FROM a, b, c"""))
def _(spark, d):
    out = R.pilot_decision(cells(spark, d), "t", "sigma", "mean", "share_positive")
    return out.select(*cols_df(["high_minus_low", "high_prob_positive", "monotone_t_rate", "monotone_sigma_rate"]), "decision")


@query("rep5_parameter_recovery", f"""
WITH e AS (SELECT l_linenumber AS t, CAST(floor(l_discount * 25) AS INTEGER) AS sigma, CASE l_returnflag WHEN 'R' THEN 'sigma_u' WHEN 'A' THEN 'sigma_eps' ELSE 'intercept' END AS parameter, l_quantity / 50 AS estimate, 0.5::DOUBLE AS truth, 1 + l_tax / 10 AS rhat FROM lineitem),
p AS (SELECT t, sigma, parameter, count(*) AS n, avg(estimate - truth) AS me, sqrt(avg((estimate - truth) * (estimate - truth))) AS rm, max(rhat) AS mr FROM e GROUP BY ALL), h AS (SELECT t, sigma, list_sort(list(DISTINCT parameter)) = ['intercept', 'sigma_eps', 'sigma_u'] AS parameters_complete FROM e GROUP BY ALL)
SELECT t, sigma, parameter, n, {r('me')} AS mean_error, {r('rm')} AS rmse, {r('mr')} AS max_rhat, parameters_complete FROM p JOIN h USING (t, sigma)""")
def _(spark, d):
    li = table(spark, d, "lineitem")
    flag = F.col("l_returnflag")
    e = li.select(F.col("l_linenumber").alias("t"), F.floor(F.col("l_discount") * 25).cast("int").alias("sigma"),
                  F.when(flag == "R", "sigma_u").when(flag == "A", "sigma_eps").otherwise("intercept").alias("parameter"),
                  (F.col("l_quantity") / 50).alias("estimate"), F.lit(0.5).alias("truth"), (1 + F.col("l_tax") / 10).alias("rhat"))
    out = R.recovery(e, ["t", "sigma"], "parameter", ["sigma_u", "sigma_eps", "intercept"])
    return out.withColumns({c: rnd(c) for c in ("mean_error", "rmse", "max_rhat")})


@query("rep6_evidence_table", sql_with("cells rep_rows", f"""
WITH {COMPLETE_SQL}, c AS (SELECT sigma, bool_and(n_missing = 0 AND n_extra = 0 AND n_duplicates = 0 AND n_unpaired = 0 OR sigma < 2) AS complete FROM cov GROUP BY sigma),
m AS (SELECT sigma, avg(mean) AS mp, avg(share_positive) AS pp, count(*) AS n_cells, CASE WHEN min(t) < max(t) THEN regr_slope(mean, t) END AS s FROM cells GROUP BY sigma)
SELECT sigma, n_cells, {r('mp')} AS mean_premium, {r('pp')} AS mean_prob_positive, {r('s')} AS slope, CASE WHEN s IS NULL THEN 'insufficient_variation' WHEN s < 0 THEN 'decreases' WHEN s > 0 THEN 'increases' ELSE 'flat' END AS direction,
 CASE WHEN NOT complete THEN 'incomplete_coverage' WHEN sigma = 0 AND abs(mp) <= 0.05 THEN 'anchor_ok' WHEN sigma = 0 THEN 'anchor_violated' WHEN mp > 0.05 THEN 'premium_present' ELSE 'no_premium' END AS label FROM m JOIN c USING (sigma)"""))
def _(spark, d):
    cov = Q.design_completeness(manifest(spark, d), rep_rows(spark, d), ["t", "sigma"], ["row", "grouped"])
    cov = cov.withColumn("complete", F.col("complete") | (F.col("sigma") < 2))
    out = R.evidence(cells(spark, d), cov, "sigma", "t", "mean", "share_positive")
    return out.select("sigma", "n_cells", *cols_df(["mean_premium", "mean_prob_positive", "slope"]), "direction", "label")
