"""Grouped summaries, correlations, concentration and rank-based statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog.common import BASE_YEAR, cleaned, derived, firm_years, samples, table, winsorized
from firmlens.catalog.panel_queries import PROFILE_COLS, PROFILE_SQL, cols_df, cols_sql, unpivot_sql
from firmlens.catalog.registry import cte, query, r, sql_with
from firmlens.functions.columns import finite, missing, rnd
from firmlens.operators import aggregates as A
from firmlens.operators import panel as P
from firmlens.operators import prep
from firmlens.operators.ordered import quantiles

AVG_RANK = "rank() OVER (PARTITION BY {p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {p}, {c}) - 1) / 2.0::DOUBLE"


def avg_rank(c, p):
    return AVG_RANK.format(c=c, p=p)


PROFILE_VARS = ["ta_scaled", "drev_scaled", "cfo_curr_scaled", "roa_lag", "size", "sd_rev", "operating_cycle"]


@query("agg1_descriptive_profile", sql_with("samples", f"SELECT sample, variable, {PROFILE_SQL} FROM {unpivot_sql('samples', 'sample', PROFILE_VARS)} GROUP BY sample, variable"))
def _(spark, d):
    out = prep.profile(samples(spark, d), ["sample"], PROFILE_VARS)
    return out.select("sample", "variable", "n_obs", *cols_df(PROFILE_COLS))


@query("agg2_exact_quantiles", f"""
SELECT variable, count(*) AS n, {', '.join(r(f'quantile_cont(x, {p})', 4) + f' AS q{int(p * 1000):03d}' for p in (0.001, 0.1, 0.5, 0.9, 0.999))}
FROM {unpivot_sql('lineitem', 'l_linestatus', ['l_extendedprice', 'l_quantity', 'l_discount'])} GROUP BY variable""")
def _(spark, d):
    q = quantiles(table(spark, d, "lineitem"), [], ["l_extendedprice", "l_quantity", "l_discount"], [0.001, 0.1, 0.5, 0.9, 0.999])
    return q.select("variable", "n", *[rnd(F.col("q")[i], 4).alias(f"q{int(p * 1000):03d}") for i, p in enumerate((0.001, 0.1, 0.5, 0.9, 0.999))])


@query("agg3_grouped_distribution", sql_with("cleaned", f"""
WITH l AS {unpivot_sql('cleaned', 'industry', ['ni', 'cfo', 'inv'])}
SELECT industry, variable, count(*) AS n, {r('avg(x)', 2)} AS mean, {r('stddev_samp(x)', 2)} AS sd, {r('min(x)', 4)} AS min, {r('max(x)', 4)} AS max,
 {', '.join(r(f'quantile_cont(x, {p})', 6) + f' AS {n}' for p, n in zip(prep.PROFILE_PROBS, prep.PROFILE_NAMES))},
 count_if(isfinite(x) AND x <= 0) AS n_nonpositive, count_if(NOT isfinite(x)) AS n_nonfinite FROM l GROUP BY industry, variable"""))
def _(spark, d):
    from firmlens.operators.ordered import unpivot

    cols = ["ni", "cfo", "inv"]
    df = cleaned(spark, d)
    prof = prep.profile(df, ["industry"], cols)
    bad = unpivot(df, ["industry"], cols).groupBy("industry", "variable").agg(
        F.count("*").alias("n"), F.count_if(finite("x") & (F.col("x") <= 0)).alias("n_nonpositive"), F.count_if(~finite("x")).alias("n_nonfinite"))
    j = prof.join(bad, ["industry", "variable"])
    return j.select("industry", "variable", "n", *cols_df(["mean", "sd"], 2), *cols_df(["min", "max"], 4), *cols_df(prep.PROFILE_NAMES, 6), "n_nonpositive", "n_nonfinite")


@query("agg4_sample_summary", sql_with("all_samples", """
SELECT sample, count(*) AS n_obs, count(DISTINCT company) AS n_firms, min(year) AS min_year, max(year) AS max_year, count(DISTINCT year) AS n_years FROM all_samples GROUP BY sample"""))
def _(spark, d):
    return A.sample_summary(samples(spark, d, list(P.SAMPLES)), ["sample"])


FUNNEL = [
    ("current assets present", "a IS NOT NULL"), ("lagged assets valid", "a_lag IS NOT NULL AND a_lag <> 0"),
    ("scaled accruals present", "ta_scaled IS NOT NULL"), ("real-time variables present", " AND ".join(f"{c} IS NOT NULL" for c in P.CORE_REAL_TIME)),
    ("next-year cash flow present", "cfo_lead_scaled IS NOT NULL"),
]


def funnel_sql():
    parts, cond = [], []
    for i, (name, c) in enumerate(FUNNEL, start=1):
        cond.append(f"({c})")
        parts.append(f"SELECT {i} AS step, '{name}' AS stage, count(*) AS n_obs, count(DISTINCT company) AS n_firms, min(year) AS min_year, max(year) AS max_year FROM derived WHERE {' AND '.join(cond)}")
    return " UNION ALL ".join(parts)


@query("agg5_sample_flow_funnel", sql_with("derived", funnel_sql()))
def _(spark, d):
    return A.funnel(derived(spark, d), [(n, F.expr(c)) for n, c in FUNNEL])


COVER_VARS = ["ta_scaled", "roa_lag", "cfo_lead_scaled", "sd_rev", "operating_cycle", "sales_growth", "rec", "ppe"]


@query("agg6_variable_coverage", sql_with("derived", " UNION ALL ".join(
    f"SELECT industry, '{c}' AS variable, count({c}) AS n_present, count(*) AS n_rows, {r(f'round(100 * count({c}) / count(*)::DOUBLE, 2)', 2)} AS pct_present FROM derived GROUP BY industry" for c in COVER_VARS)))
def _(spark, d):
    out = A.variable_coverage(derived(spark, d), ["industry"], COVER_VARS)
    return out.select("industry", "variable", "n_present", "n_rows", rnd("pct_present", 2).alias("pct_present"))


def _requirements():
    from firmlens.plans.models import FORMULAS, required_variables

    return {m: ["ta_scaled"] + required_variables(m) for m in FORMULAS}


@query("agg6_model_availability", sql_with("derived", " UNION ALL ".join(
    f"SELECT '{m}' AS model_id, count(*) AS n_available FROM derived WHERE {' AND '.join(c + ' IS NOT NULL' for c in v)}" for m, v in _requirements().items())))
def _(spark, d):
    return A.availability(derived(spark, d), _requirements())


@query("agg7_panel_coverage", sql_with("samples", f"""
WITH p AS (SELECT sample, company, count(DISTINCT year) AS n FROM samples GROUP BY ALL)
SELECT sample, CAST(sum(n) AS BIGINT) AS n_observations, count(*) AS n_firms, {r('avg(n)')} AS mean_years, {r('quantile_cont(n, 0.5)')} AS median_years, min(n) AS min_years, max(n) AS max_years,
 {', '.join(r(f'avg(CASE WHEN n = {i} THEN 1.0 ELSE 0.0 END)') + f' AS share_{i}_years' for i in (1, 2, 3, 4))}, {r('avg(CASE WHEN n >= 5 THEN 1.0 ELSE 0.0 END)')} AS share_5plus_years,
 count_if(n = 1) AS singleton_firms, count_if(n >= 2) AS eligible_firms FROM p GROUP BY sample"""))
def _(spark, d):
    out = A.panel_coverage(samples(spark, d), ["sample"])
    dbl = ["mean_years", "median_years", "share_1_years", "share_2_years", "share_3_years", "share_4_years", "share_5plus_years"]
    return out.select(*[rnd(c).alias(c) if c in dbl else F.col(c) for c in out.columns])


@query("agg8_industry_year_cells", sql_with("samples", f"""
WITH p AS (SELECT sample, industry, year, count(*) AS n FROM samples GROUP BY ALL)
SELECT sample, count(*) AS n_cells, {r('avg(n)')} AS mean_obs, {r('quantile_cont(n, 0.5)')} AS median_obs, min(n) AS min_obs, max(n) AS max_obs,
 count_if(n = 1) AS n_eq_1, count_if(n < 5) AS n_lt_5, count_if(n < 10) AS n_lt_10, {r('avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END)')} AS share_eq_1,
 {r('avg(CASE WHEN n < 5 THEN 1.0 ELSE 0.0 END)')} AS share_lt_5, {r('avg(CASE WHEN n < 10 THEN 1.0 ELSE 0.0 END)')} AS share_lt_10 FROM p GROUP BY sample"""))
def _(spark, d):
    out = A.cell_coverage(samples(spark, d), ["sample"], ["industry", "year"])
    return out.select(*[rnd(c).alias(c) if c.startswith(("share", "mean", "median")) else F.col(c) for c in out.columns])


TREAT = {"ppe": "zero_to_missing", "rec": "zero_to_missing", "cogs": "zero_to_missing", "inv": "zero_kept", "rev": "zero_kept", "a": "row_dropped"}


@query("agg9_zero_value_audit", sql_with("firm_years derived", " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, (SELECT count({c}) FROM firm_years) AS n_nonmissing, (SELECT count_if({c} = 0) FROM firm_years) AS n_zero, (SELECT count_if({c} IS NULL) FROM derived) AS n_lost_downstream, '{t}' AS treatment,
 {r(f"(SELECT count_if({c} = 0) / count({c})::DOUBLE FROM firm_years)")} AS zero_share,
 {'(SELECT count_if(' + c + ' = 0) FROM firm_years)' if t == 'zero_to_missing' else '0::BIGINT'} AS n_converted, {'(SELECT count_if(' + c + ' = 0) FROM firm_years)' if t == 'zero_kept' else '0::BIGINT'} AS n_retained""" for c, t in TREAT.items())))
def _(spark, d):
    out = A.zero_audit(firm_years(spark, d), derived(spark, d), TREAT)
    return out.withColumn("zero_share", rnd("zero_share"))


@query("agg10_group_share", sql_with("samples", f"""
SELECT sample, industry, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY sample)::DOUBLE')} AS share, {r('avg(ta_scaled)')} AS mean_ta_scaled, {r('avg(sales_growth)')} AS mean_sales_growth FROM samples GROUP BY sample, industry"""))
def _(spark, d):
    out = A.share_within(samples(spark, d), ["sample"], "industry", ["ta_scaled", "sales_growth"])
    return out.select("sample", "industry", "n", *cols_df(["share", "mean_ta_scaled", "mean_sales_growth"]))


@query("agg11_concentration", sql_with("derived", f"""
WITH p AS (SELECT industry, company, count(*) AS n FROM derived WHERE neg_cfo = 1 GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY industry) AS t, row_number() OVER (PARTITION BY industry ORDER BY n DESC, company) AS rn FROM p)
SELECT industry, CAST(max(t) AS BIGINT) AS n_obs, count(*) AS n_firms, max(n) AS max_obs_per_firm, {r('max(n / t::DOUBLE)')} AS max_firm_share, count_if(n / t::DOUBLE >= 0.05) AS n_firms_ge_5pct,
 count_if(n / t::DOUBLE >= 0.10) AS n_firms_ge_10pct, max(CASE WHEN rn = 1 THEN company END) AS top_firm FROM t GROUP BY industry"""))
def _(spark, d):
    out = A.concentration(derived(spark, d).filter("neg_cfo = 1"), ["industry"])
    return out.withColumn("max_firm_share", rnd("max_firm_share"))


@query("agg12_dominant_category", """
WITH p AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_custkey, o_orderpriority AS dominant_o_orderpriority, CAST(t AS BIGINT) AS n_rows FROM (SELECT *, sum(n) OVER (PARTITION BY o_custkey) AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) AS rn FROM p) WHERE rn = 1""")
def _(spark, d):
    return A.dominant_category(table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("agg13_two_stage_rollup", sql_with("samples", f"""
WITH f AS (SELECT sample, industry, year, count(*) AS n, sum(ta_scaled) AS total, avg(ta_scaled) AS m, sqrt(avg(ta_scaled * ta_scaled)) AS rmse FROM samples GROUP BY ALL)
SELECT sample, industry, CAST(sum(n) AS BIGINT) AS n_obs, {r('sum(n * m) / sum(n)')} AS weighted_mean, {r('sqrt(sum(n * rmse * rmse) / sum(n))')} AS rms, {r('stddev_samp(total)')} AS sd_over_folds FROM f GROUP BY sample, industry"""))
def _(spark, d):
    from firmlens.operators.stacking import weighted_rollup

    s = samples(spark, d)
    x = F.col("ta_scaled")
    per = s.groupBy("sample", "industry", "year").agg(F.count("*").alias("n"), F.sum(x).alias("total"), F.avg(x).alias("m"), F.sqrt(F.avg(x * x)).alias("rmse"))
    out = weighted_rollup(per, ["sample", "industry"], "n", mean="m", rms="rmse", spread="total")
    return out.select("sample", "industry", "n_obs", rnd("m").alias("weighted_mean"), rnd("rmse").alias("rms"), rnd("sd_total").alias("sd_over_folds"))


@query("agg14_distribution_text", sql_with("samples", """
WITH p AS (SELECT sample, industry, year, count(*) AS n FROM samples GROUP BY ALL)
SELECT sample, industry, string_agg(year || '=' || n, ';' ORDER BY n DESC, year) AS by_count, string_agg(year || ':' || n, ';' ORDER BY year) AS by_year FROM p GROUP BY sample, industry"""))
def _(spark, d):
    s = samples(spark, d)
    ks = ["sample", "industry"]
    return A.distribution_text(s, ks, "year", "by_count").join(A.distribution_text(s, ks, "year", "by_year", eq=":", by_key=True), ks)


@query("agg15_distinct_text", sql_with("cleaned", "SELECT industry, string_agg(v, ' | ' ORDER BY v) AS years FROM (SELECT DISTINCT industry, CAST(year AS VARCHAR) AS v FROM cleaned) GROUP BY industry"))
def _(spark, d):
    return A.distinct_text(cleaned(spark, d), ["industry"], "year", "years")


@query("agg16_pearson", sql_with("samples", f"SELECT sample, industry, count(*) AS n, {r('CASE WHEN count(*) >= 3 THEN corr(ta_scaled, cfo_curr_scaled) END')} AS pearson FROM samples GROUP BY sample, industry"))
def _(spark, d):
    return A.pearson(samples(spark, d), ["sample", "industry"], "ta_scaled", "cfo_curr_scaled").withColumn("pearson", rnd("pearson"))


@query("agg17_spearman", sql_with("winsorized", f"""
SELECT sample, count(*) AS n, {r('corr(ra, rb)')} AS spearman FROM (SELECT sample, {avg_rank('ta_scaled', 'sample')} AS ra, {avg_rank('cfo_curr_scaled', 'sample')} AS rb FROM winsorized) GROUP BY sample"""))
def _(spark, d):
    return A.spearman(winsorized(spark, d), ["sample"], "ta_scaled", "cfo_curr_scaled").withColumn("spearman", rnd("spearman"))


CM = ["ta_scaled", "drev_scaled", "cfo_curr_scaled", "roa_lag"]


def corr_sql():
    ranks = ", ".join(f"{avg_rank(c, '1')} AS r_{c}" for c in CM)
    return "WITH k AS (SELECT *, " + ranks + " FROM samples WHERE sample = 'ex_post') " + " UNION ALL ".join(
        f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, {r(f'corr({a}, {b})')} AS pearson, {r(f'corr(r_{a}, r_{b})')} AS spearman FROM k" for a in CM for b in CM)


@query("agg18_correlation_matrix", sql_with("samples", corr_sql()))
def _(spark, d):
    s = samples(spark, d, ["ex_post"])
    out = A.correlation_matrix(s, ["company", "year"], CM)
    return out.select("variable_1", "variable_2", *cols_df(["pearson", "spearman"]))


@query("agg19_paired_difference", sql_with("samples", f"""
WITH p AS (SELECT sample, size AS x, ln(a_lag) AS y FROM samples)
SELECT sample, count(*) AS n, {r('avg(x - y)')} AS mean_difference, {r('quantile_cont(x - y, 0.5)')} AS median_difference, {r('quantile_cont(abs(x - y), 0.95)')} AS p95_abs_difference,
 {r('avg(x / nullif(y, 0))')} AS ratio_mean, {r('quantile_cont(x / nullif(y, 0), 0.5)')} AS ratio_median, {r('quantile_cont(x / nullif(y, 0), 0.05)')} AS ratio_p05, {r('quantile_cont(x / nullif(y, 0), 0.95)')} AS ratio_p95,
 {r('avg(CASE WHEN x < y THEN 1.0 ELSE 0.0 END)')} AS share_a_lt_b, {r('avg(CASE WHEN y < x THEN 1.0 ELSE 0.0 END)')} AS share_b_lt_a FROM p GROUP BY sample"""))
def _(spark, d):
    s = samples(spark, d).select("sample", F.col("size").alias("x"), F.log("a_lag").alias("y"))
    out = A.paired_difference(s, ["sample"], "x", "y")
    return out.select("sample", "n", *cols_df([c for c in out.columns if c not in ("sample", "n")]))


cte("winsorized_wide", "samples", f"""SELECT s.*, CASE WHEN ta_scaled IS NOT NULL THEN least(greatest(ta_scaled, lo5), hi5) END AS ta_5_95 FROM samples s
JOIN (SELECT sample, quantile_cont(ta_scaled, 0.05) AS lo5, quantile_cont(ta_scaled, 0.95) AS hi5 FROM samples GROUP BY sample) USING (sample)""")


@query("agg20_scenario_stability", sql_with("winsorized winsorized_wide", f"""
WITH j AS (SELECT sample, b.ta_scaled AS s0, o.ta_5_95 AS s1, abs(b.ta_scaled) > 1 AS f0, abs(o.ta_5_95) > 1 AS f1 FROM winsorized b JOIN winsorized_wide o USING (sample, company, year)),
k AS (SELECT *, {avg_rank('s0', 'sample')} AS r0, {avg_rank('s1', 'sample')} AS r1 FROM j)
SELECT sample, count(*) AS n, {r('corr(s0, s1)')} AS pearson, {r('corr(r0, r1)')} AS spearman, {r('avg(abs(s0 - s1))')} AS mean_abs_difference, {r('avg(CASE WHEN f0 = f1 THEN 1.0 ELSE 0.0 END)')} AS flag_agreement,
 {r('avg(s1)')} AS scenario_mean, {r('stddev_samp(s1)')} AS scenario_sd, CASE WHEN corr(r0, r1) < 0.90 OR avg(abs(s0 - s1)) > 0.25 THEN 'REVIEW_SENSITIVITY' ELSE 'STABLE' END AS stability_flag FROM k GROUP BY sample"""))
def _(spark, d):
    s = samples(spark, d).select("sample", "company", "year", "ta_scaled")
    flag = (F.abs("ta_scaled") > 1).alias("extreme")
    base = prep.winsorize(s, ["sample"], ["ta_scaled"]).select("*", flag)
    other = prep.winsorize(s, ["sample"], ["ta_scaled"], 0.05, 0.95).select("*", flag)
    out = A.stability(base, other, ["sample"], ["company", "year"], "ta_scaled", "extreme")
    return out.select("sample", "n", "stability_flag", *cols_df(["pearson", "spearman", "mean_abs_difference", "flag_agreement", "scenario_mean", "scenario_sd"]))


@query("agg21_slope_direction", sql_with("winsorized", f"""
SELECT *, CASE WHEN slope IS NULL THEN 'insufficient_variation' WHEN slope < 0 THEN 'decreases' WHEN slope > 0 THEN 'increases' ELSE 'flat' END AS direction FROM
 (SELECT sample, industry, count(*) AS n, {r('CASE WHEN min(year) < max(year) THEN regr_slope(ta_scaled, year) END')} AS slope FROM winsorized GROUP BY sample, industry)"""))
def _(spark, d):
    return A.slope(winsorized(spark, d), ["sample", "industry"], "year", "ta_scaled").withColumn("slope", rnd("slope"))


@query("agg22_pivot", sql_with("samples", f"""
SELECT industry, year, {r("max(CASE WHEN sample = 'ex_post' THEN m END)")} AS ex_post, {r("max(CASE WHEN sample = 'real_time' THEN m END)")} AS real_time
FROM (SELECT sample, industry, year, avg(ta_scaled) AS m FROM samples GROUP BY ALL) GROUP BY industry, year"""))
def _(spark, d):
    p = samples(spark, d).groupBy("industry", "year").pivot("sample", ["ex_post", "real_time"]).agg(F.avg("ta_scaled"))
    return p.select("industry", "year", *cols_df(["ex_post", "real_time"]))


@query("agg23_extreme_flag_counts", sql_with("samples", f"""
WITH m AS {unpivot_sql('samples', 'sample', ['ta_scaled', 'drev_scaled', 'roa_lag'])}, f AS {unpivot_sql('samples', 'sample', ['neg_cfo', 'neg_earn'])},
c AS (SELECT sample, variable, quantile_cont(abs(x), 0.95) AS cut FROM m GROUP BY ALL)
SELECT sample, variable, count(*) AS n_obs, count_if(abs(x) >= cut) AS n_flagged, {r('count_if(abs(x) >= cut) / count(*)::DOUBLE')} AS flag_rate FROM m JOIN c USING (sample, variable) GROUP BY sample, variable
UNION ALL SELECT sample, variable, count(*), count_if(x = 1), {r('count_if(x = 1) / count(*)::DOUBLE')} FROM f GROUP BY sample, variable"""))
def _(spark, d):
    out = A.extreme_counts(samples(spark, d), ["sample"], ["ta_scaled", "drev_scaled", "roa_lag"], ["neg_cfo", "neg_earn"])
    return out.withColumn("flag_rate", rnd("flag_rate"))


@query("agg25_kolmogorov_smirnov", sql_with("winsorized", f"""
WITH v AS (SELECT sample, ta_scaled AS x, industry = 'BUILDING' AS side FROM winsorized), c AS (SELECT sample, x, count_if(side) AS ca, count_if(NOT side) AS cb FROM v GROUP BY ALL),
k AS (SELECT sample, sum(ca) OVER o AS fa, sum(cb) OVER o AS fb, sum(ca) OVER (PARTITION BY sample) AS n_a, sum(cb) OVER (PARTITION BY sample) AS n_b FROM c WINDOW o AS (PARTITION BY sample ORDER BY x))
SELECT sample, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b, {r('max(abs(fa / n_a::DOUBLE - fb / n_b::DOUBLE))')} AS ks_d FROM k GROUP BY sample"""))
def _(spark, d):
    w = winsorized(spark, d).withColumn("side", F.col("industry") == "BUILDING")
    return A.ks_statistic(w, ["sample"], "ta_scaled", "side").withColumn("ks_d", rnd("ks_d"))


@query("agg26_group_means", sql_with("derived", f"SELECT industry, count(*) AS n, {r('avg(sd_rev)')} AS mean_sd_rev, {r('avg(sd_cfo)')} AS mean_sd_cfo, {r('avg(size)')} AS mean_size FROM derived GROUP BY industry"))
def _(spark, d):
    return derived(spark, d).groupBy("industry").agg(F.count("*").alias("n"), *[rnd(F.avg(c)).alias(f"mean_{c}") for c in ("sd_rev", "sd_cfo", "size")])
