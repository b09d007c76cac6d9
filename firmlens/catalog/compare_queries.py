"""Ranks over whole samples, matched top-share comparison, folds and fold-local preprocessing."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.catalog.aggregate_queries import avg_rank
from firmlens.catalog.common import K, cleaned, da_joined, da_table, derived, folded, samples, table, winsorized
from firmlens.catalog.panel_queries import cols_df, cols_sql, unpivot_sql
from firmlens.catalog.registry import cte, query, r, sql_with
from firmlens.functions.columns import missing, rnd
from firmlens.operators import compare as C
from firmlens.operators import cv, infer, prep

# --- ranks and windows over whole samples -------------------------------------------------------------


@query("win3_total_order_rank", sql_with("da", """
SELECT scheme, sample, company, year, row_number() OVER (PARTITION BY scheme, sample ORDER BY abs(da_z_est) DESC, company, year) AS rank,
 row_number() OVER (PARTITION BY scheme, sample ORDER BY abs(da_z_est) DESC, company, year) <= ceil(0.05::DOUBLE * count(*) OVER (PARTITION BY scheme, sample)) AS top_flag FROM da"""))
def _(spark, d):
    da = da_table(spark, d).select("scheme", "sample", "company", "year", F.abs("da_z_est").alias("score"))
    return C.ranked_scores(da, ["scheme", "sample"], "score", nonfinite_last=True).select("scheme", "sample", "company", "year", "rank", "top_flag")


@query("win4_cutoff_ties", sql_with("samples", """
WITH s AS (SELECT sample, CAST(round(sales_growth, 1) AS DOUBLE) AS score, row_number() OVER (PARTITION BY sample ORDER BY round(sales_growth, 1) DESC, company, year) AS rk,
  greatest(1, ceil(0.05::DOUBLE * count(*) OVER (PARTITION BY sample))) AS top_n FROM samples),
c AS (SELECT sample, score AS cut, CAST(top_n AS BIGINT) AS top_n FROM s WHERE rk = top_n)
SELECT sample, max(c.top_n) AS top_n, max(cut) + 0.0 AS cutoff_score, count_if(score = cut) AS cutoff_tie_count, count_if(score = cut) > 1 AS cutoff_tie_flag FROM s JOIN c USING (sample) GROUP BY sample"""))
def _(spark, d):
    s = samples(spark, d).select("sample", "company", "year", F.round("sales_growth", 1).alias("score"))
    return C.cutoff_ties(C.ranked_scores(s, ["sample"], "score"), ["sample"], "score")


@query("win6_top_k_per_group", sql_with("derived", f"""
SELECT industry, year, company, {r('rev', 4)} AS rev, rk FROM (SELECT *, row_number() OVER (PARTITION BY industry, year ORDER BY rev DESC, company) AS rk FROM derived) WHERE rk <= 3"""))
def _(spark, d):
    # rank <= k over a window is cut to k rows per group before the shuffle.
    w = W.partitionBy("industry", "year").orderBy(F.desc("rev"), "company")
    top = derived(spark, d).withColumn("rk", F.row_number().over(w)).filter("rk <= 3")
    return top.select("industry", "year", "company", rnd("rev", 4).alias("rev"), F.col("rk").cast("long").alias("rk"))


cte("industry_year", "samples", "SELECT sample, industry, year, avg(ta_scaled) AS v FROM samples GROUP BY ALL")


@query("win7_relative_to_anchor", sql_with("industry_year", f"""
SELECT sample, industry, year, {r('v')} AS value, {r('v - first_value(v) OVER (PARTITION BY sample, industry ORDER BY abs(year - 1998), year)')} AS relative_value,
 {r('abs(v) / nullif(max(abs(v)) OVER (PARTITION BY sample, year), 0)')} AS share_of_max, {r("abs(v) / nullif(max(CASE WHEN industry = 'BUILDING' THEN abs(v) END) OVER (PARTITION BY sample, year), 0)")} AS ratio_to_building FROM industry_year"""))
def _(spark, d):
    v = samples(spark, d).groupBy("sample", "industry", "year").agg(F.avg("ta_scaled").alias("v"))
    a = infer.anchored(v, ["sample", "industry"], "year", "v", 1998)
    out = infer.relative_to(a, ["sample", "year"], "industry", "v", ["BUILDING"])
    return out.select("sample", "industry", "year", rnd("v").alias("value"), rnd("relative_value").alias("relative_value"),
                      rnd("share_of_max").alias("share_of_max"), rnd("ratio_to_BUILDING").alias("ratio_to_building"))


P_SQL = "least(1.0, exp(-0.717 * abs(da_z_pred) - 0.416 * da_z_pred * da_z_pred))"


@query("win8_benjamini_hochberg", sql_with("da", f"""
WITH p AS (SELECT scheme, sample, company, year, {P_SQL} AS p FROM da),
k AS (SELECT *, count(*) OVER (PARTITION BY scheme, sample) AS m, row_number() OVER (PARTITION BY scheme, sample ORDER BY p, company, year) AS rk,
  count(*) OVER () AS mg, row_number() OVER (ORDER BY p, scheme, sample, company, year) AS rg FROM p)
SELECT scheme, sample, company, year, {r('p')} AS p, {r('least(1.0, min(p * m / rk) OVER (PARTITION BY scheme, sample ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q_family,
 {r('least(1.0, min(p * mg / rg) OVER (ORDER BY rg ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))')} AS q_global FROM k"""))
def _(spark, d):
    z = F.col("da_z_pred")
    p = F.least(F.lit(1.0), F.exp(F.lit(-0.717) * F.abs(z) - F.lit(0.416) * z * z))
    da = da_table(spark, d).select("scheme", "sample", "company", "year", p.alias("p"))
    fam = infer.benjamini_hochberg(da, ["scheme", "sample"], "p", ["company", "year"], "q_family").drop("n_tests")
    both = infer.benjamini_hochberg(fam, [], "p", ["scheme", "sample", "company", "year"], "q_global")
    return both.select("scheme", "sample", "company", "year", *cols_df(["p", "q_family", "q_global"]))


@query("win9_monotonicity_rate", sql_with("cleaned", f"""
SELECT industry, count(*) AS n_groups, count_if(ok) AS n_monotone, {r('avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END)')} AS monotone_rate FROM (SELECT industry, company, bool_and(coalesce(dx >= -0.25, true)) AS ok FROM
 (SELECT industry, company, ln(a) - lag(ln(a)) OVER (PARTITION BY industry, company ORDER BY year) AS dx FROM cleaned) GROUP BY ALL) GROUP BY industry"""))
def _(spark, d):
    c = cleaned(spark, d).select("industry", "company", "year", F.log("a").alias("la"))
    out = infer.monotonicity_rate(c, ["company"], ["industry"], "year", "la", 0.25)
    return out.withColumn("monotone_rate", rnd("monotone_rate"))


# --- folds -------------------------------------------------------------------------------------------

@query("cv1_grouped_folds_stratified", sql_with("folds_grouped", "SELECT company, industry, fold_id FROM folds_grouped"))
def _(spark, d):
    return cv.grouped_folds(samples(spark, d), K)


@query("cv1_grouped_folds_plain", sql_with("samples", """
SELECT company, CAST((row_number() OVER (ORDER BY md5(concat_ws(':', '42', 'grouped', company)), company) - 1) % 5 + 1 AS INTEGER) AS fold_id FROM (SELECT DISTINCT company FROM samples)"""))
def _(spark, d):
    return cv.grouped_folds(samples(spark, d), K, stratified=False).select("company", "fold_id")


@query("cv2_row_folds", sql_with("folds_row", "SELECT sample, company, year, fold_id FROM folds_row"))
def _(spark, d):
    return cv.row_folds(samples(spark, d), K, keys=["sample"]).select("sample", "company", "year", "fold_id")


@query("cv3_plain_row_folds", sql_with("samples", """
SELECT company, year, CAST((row_number() OVER (ORDER BY md5(concat_ws(':', '42', 'plain', company, CAST(year AS VARCHAR))), company, year) - 1) % 5 + 1 AS INTEGER) AS fold_id FROM samples WHERE sample = 'real_time'"""))
def _(spark, d):
    return cv.plain_row_folds(samples(spark, d, ["real_time"]).select("company", "year"), K)


ZV = ["ta_scaled", "drev_scaled", "ppe_scaled", "roa_lag"]


@query("cv4_train_side_statistics", sql_with("folded_grouped", " UNION ALL ".join(
    f"SELECT t.sample, '{c}' AS variable, k.fold, count(*) AS n_train, {r(f'avg({c})')} AS mean, {r(f'stddev_samp({c})')} AS sd FROM folded_grouped t JOIN (SELECT unnest(range(1, 6))::INTEGER AS fold) k ON t.fold_id <> k.fold GROUP BY t.sample, k.fold" for c in ZV)))
def _(spark, d):
    out = prep.complement_moments(folded(spark, d, "grouped"), ["sample"], ZV)
    return out.select("sample", "variable", "fold", "n_train", *cols_df(["mean", "sd"]))


def dist_sql(src, keys, cat, order, eq, out):
    return f"SELECT {keys}, string_agg({cat} || '{eq}' || n, ';' ORDER BY {order}) AS {out} FROM (SELECT {keys}, {cat}, count(*) AS n FROM {src} GROUP BY ALL) GROUP BY {keys}"


@query("cv5_fold_balance", sql_with("folded_grouped", f"""
WITH p AS (SELECT sample, fold_id, company, count(*) AS n, min(year) AS y0, max(year) AS y1 FROM folded_grouped GROUP BY ALL),
b AS (SELECT sample, fold_id, count(*) AS n_firms, CAST(sum(n) AS BIGINT) AS n_obs, min(n) AS min_obs_per_firm, {r('quantile_cont(n, 0.5)')} AS median_obs_per_firm, max(n) AS max_obs_per_firm, min(y0) AS min_year, max(y1) AS max_year FROM p GROUP BY sample, fold_id)
SELECT * FROM b JOIN ({dist_sql('folded_grouped', 'sample, fold_id', 'year', 'year', ':', 'year_distribution')}) USING (sample, fold_id)
JOIN ({dist_sql('folded_grouped', 'sample, fold_id', 'industry', 'n DESC, industry', '=', 'industry_distribution')}) USING (sample, fold_id)"""))
def _(spark, d):
    return cv.fold_balance(folded(spark, d, "grouped"), ["sample"]).withColumn("median_obs_per_firm", rnd("median_obs_per_firm"))


@query("cv6_fold_diagnostics", sql_with("folded_row", f"""
WITH i AS (SELECT sample, fold_id, industry, sum(n) AS n_ind, count(*) AS cells FROM (SELECT sample, fold_id, industry, year, count(*) AS n FROM folded_row GROUP BY ALL) GROUP BY ALL),
w AS (SELECT sample, fold_id, count(*) AS n_industries, CAST(sum(cells) AS BIGINT) AS n_industry_year_cells, max(n_ind) / sum(n_ind)::DOUBLE AS s, CAST(sum(n_ind) AS BIGINT) AS n_obs FROM i GROUP BY sample, fold_id),
f AS (SELECT sample, fold_id, count(DISTINCT company) AS n_firms FROM folded_row GROUP BY sample, fold_id),
l AS (SELECT i.sample, i.fold_id, count_if(i.n_ind = t.t) AS n_industries_absent_from_training FROM i JOIN (SELECT sample, industry, sum(n_ind) AS t FROM i GROUP BY ALL) t USING (sample, industry) GROUP BY i.sample, i.fold_id)
SELECT sample, fold_id, n_industries, n_industry_year_cells, {r('s')} AS largest_industry_share, n_obs, n_firms, n_industries_absent_from_training, n_firms < 20 AS too_few_firms,
 {r('max(n_obs) OVER (PARTITION BY sample) / (min(n_obs) OVER (PARTITION BY sample))::DOUBLE')} AS obs_imbalance_ratio, {r('max(n_firms) OVER (PARTITION BY sample) / (min(n_firms) OVER (PARTITION BY sample))::DOUBLE')} AS firm_imbalance_ratio
FROM w JOIN f USING (sample, fold_id) JOIN l USING (sample, fold_id)"""))
def _(spark, d):
    out = cv.fold_diagnostics(folded(spark, d, "row"), ["sample"])
    dbl = ["largest_industry_share", "obs_imbalance_ratio", "firm_imbalance_ratio"]
    return out.withColumns({c: rnd(c) for c in dbl})


@query("cv7_stratum_coverage", sql_with("folded_grouped", """
SELECT sample, industry, count(DISTINCT company) AS n_firms, count(DISTINCT fold_id) AS n_folds, count(DISTINCT fold_id) = 5 AS in_every_fold,
 CASE WHEN count(DISTINCT company) < 5 THEN 'BLOCK_SPARSE_STRATUM' ELSE 'OK' END AS stratum_status FROM folded_grouped GROUP BY sample, industry"""))
def _(spark, d):
    return cv.stratum_coverage(folded(spark, d, "grouped"), ["sample"], K)


@query("cv8_level_coverage", """
WITH o AS (SELECT o_custkey % 97 AS k, o_orderpriority AS p, o_orderkey % 5 AS f FROM orders), te AS (SELECT * FROM o WHERE f = 0), tr AS (SELECT * FROM o WHERE f <> 0 AND k <> 3 AND p <> '1-URGENT')
SELECT 'k' AS column_name, CAST(k AS VARCHAR) AS level, count(*) AS n_rows FROM te WHERE k NOT IN (SELECT k FROM tr) GROUP BY k
UNION ALL SELECT 'p', p, count(*) FROM te WHERE p NOT IN (SELECT p FROM tr) GROUP BY p""")
def _(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 97).alias("k"), F.col("o_orderpriority").alias("p"), (F.col("o_orderkey") % 5).alias("f"))
    return cv.level_coverage(o.filter("f <> 0 and k <> 3 and p <> '1-URGENT'"), o.filter("f = 0"), ["k", "p"])


@query("cv8_split_firms", sql_with("folded_row", "SELECT sample, company, count(DISTINCT fold_id) AS n_folds FROM folded_row GROUP BY sample, company HAVING count(DISTINCT fold_id) > 1"))
def _(spark, d):
    return cv.split_firms(folded(spark, d, "row"), ["sample"])


@query("cv9_history_flags", sql_with("folded_row", """
SELECT a.sample, a.company, a.year, EXISTS (SELECT 1 FROM folded_row b WHERE b.sample = a.sample AND b.company = a.company AND b.fold_id <> a.fold_id) AS same_firm_history_available FROM folded_row a"""))
def _(spark, d):
    return cv.history_flags(folded(spark, d, "row"), ["sample"]).select("sample", "company", "year", "same_firm_history_available")


@query("join9_fold_train_test_views", sql_with("folded_grouped", f"""
SELECT sample, k.fold, CASE WHEN fold_id = k.fold THEN 'test' ELSE 'train' END AS part, count(*) AS n_rows, {r('avg(ta_scaled)')} AS mean_ta FROM folded_grouped CROSS JOIN (SELECT unnest(range(1, 6))::INTEGER AS fold) k GROUP BY ALL"""))
def _(spark, d):
    v = prep.fold_views(folded(spark, d, "grouped"), K)
    return v.groupBy("sample", "fold", "part").agg(F.count("*").alias("n_rows"), rnd(F.avg("ta_scaled")).alias("mean_ta"))


# --- fold-local preprocessing --------------------------------------------------------------------------

cte("raw_folded", "samples folds_grouped", "SELECT s.*, f.fold_id FROM samples s JOIN folds_grouped f USING (company)")
cte("fold_views", "raw_folded", "SELECT r.*, k.fold, CASE WHEN fold_id = k.fold THEN 'test' ELSE 'train' END AS part FROM raw_folded r CROSS JOIN (SELECT unnest(range(1, 6))::INTEGER AS fold) k")


def fold_cut_sql():
    q = ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in ZV)
    rep = ", ".join(f"least(greatest({c}, lo_{c}), hi_{c}) AS {c}" for c in ZV)
    z = ", ".join(f"CASE WHEN sd_{c} > 0 THEN ({c} - m_{c}) / sd_{c} ELSE 0 END AS {c}" for c in ZV)
    m = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS sd_{c}" for c in ZV)
    return f"""WITH q AS (SELECT sample, fold, {q} FROM fold_views WHERE part = 'train' GROUP BY sample, fold),
w AS (SELECT v.sample, v.fold, v.part, v.company, v.year, {rep} FROM fold_views v JOIN q USING (sample, fold)),
m AS (SELECT sample, fold, {m} FROM w WHERE part = 'train' GROUP BY sample, fold),
z AS (SELECT w.sample, w.fold, w.part, w.company, w.year, {z} FROM w JOIN m USING (sample, fold))
SELECT sample, fold, company, year, {cols_sql(ZV)} FROM z WHERE part = 'test'"""


def raw_folded(spark, d):
    s = samples(spark, d)
    return s.join(cv.grouped_folds(s, K).drop("industry"), "company")


@query("pre5_fold_local_preprocessing", sql_with("fold_views", fold_cut_sql()))
def _(spark, d):
    z = prep.fold_local(raw_folded(spark, d).select("sample", "company", "year", "fold_id", *ZV), ["sample"], ZV, K, part="test")
    return z.select("sample", "fold", "company", "year", *cols_df(ZV))


@query("pre6_fold_local_standardisation", sql_with("folded_row", "WITH m AS (SELECT t.sample, k.fold, " + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS sd_{c}" for c in ZV)
       + " FROM folded_row t JOIN (SELECT unnest(range(1, 6))::INTEGER AS fold) k ON t.fold_id <> k.fold GROUP BY t.sample, k.fold) SELECT t.sample, t.company, t.year, "
       + ", ".join(f"{r(f'CASE WHEN sd_{c} > 0 THEN ({c} - m_{c}) / sd_{c} ELSE 0 END')} AS {c}" for c in ZV) + " FROM folded_row t JOIN m ON m.sample = t.sample AND m.fold = t.fold_id"))
def _(spark, d):
    rows = folded(spark, d, "row").select("sample", "company", "year", F.col("fold_id").alias("fold"), *ZV)
    st = prep.complement_moments(folded(spark, d, "row"), ["sample"], ZV)
    return prep.apply_zscore(rows, st, ["sample", "fold"], ZV).select("sample", "company", "year", *cols_df(ZV))


@query("pre7_leakage_audit", sql_with("fold_views raw_folded", f"""
WITH v AS {unpivot_sql('fold_views', 'sample, fold, part', ZV)}, q AS (SELECT sample, fold, variable, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM v WHERE part = 'train' GROUP BY ALL),
g AS (SELECT sample, variable, quantile_cont(x, 0.01) AS glo, quantile_cont(x, 0.99) AS ghi FROM {unpivot_sql('raw_folded', 'sample', ZV)} GROUP BY ALL)
SELECT sample, fold, variable, {r('max(lo)')} AS train_lo, {r('max(hi)')} AS train_hi, count_if(part = 'train') AS n_train, count_if(part = 'test') AS n_test,
 count_if(part = 'train' AND x < lo) AS train_low, count_if(part = 'train' AND x > hi) AS train_high, count_if(part = 'test' AND x < lo) AS test_low, count_if(part = 'test' AND x > hi) AS test_high,
 {r('max(lo - glo)')} AS delta_lo, {r('max(hi - ghi)')} AS delta_hi, {r("count_if(part = 'test' AND x < lo) / nullif(count_if(part = 'test'), 0)::DOUBLE")} AS share_test_low,
 {r("count_if(part = 'test' AND x > hi) / nullif(count_if(part = 'test'), 0)::DOUBLE")} AS share_test_high FROM v JOIN q USING (sample, fold, variable) JOIN g USING (sample, variable) GROUP BY sample, fold, variable"""))
def _(spark, d):
    out = prep.leakage_audit(raw_folded(spark, d).select("sample", "fold_id", *ZV), ["sample"], ZV, K)
    return out.withColumns({c: rnd(c) for c in ("train_lo", "train_hi", "delta_lo", "delta_hi", "share_test_low", "share_test_high")})


@query("pre7_leakage_summary", sql_with("fold_views raw_folded", f"""
WITH v AS {unpivot_sql('fold_views', 'sample, fold, part', ZV)}, q AS (SELECT sample, fold, variable, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM v WHERE part = 'train' GROUP BY ALL),
g AS (SELECT sample, variable, quantile_cont(x, 0.01) AS glo, quantile_cont(x, 0.99) AS ghi FROM {unpivot_sql('raw_folded', 'sample', ZV)} GROUP BY ALL),
a AS (SELECT sample, fold, variable, max(abs(lo - glo)) AS dl, max(abs(hi - ghi)) AS dh, count_if(part = 'test' AND (x < lo OR x > hi)) / count_if(part = 'test')::DOUBLE AS sh FROM v JOIN q USING (sample, fold, variable) JOIN g USING (sample, variable) GROUP BY ALL)
SELECT sample, variable, {r('max(greatest(dl, dh))')} AS max_abs_delta, {r('max(sh)')} AS max_test_share FROM a GROUP BY sample, variable"""))
def _(spark, d):
    a = prep.leakage_audit(raw_folded(spark, d).select("sample", "fold_id", *ZV), ["sample"], ZV, K)
    return a.groupBy("sample", "variable").agg(
        rnd(F.max(F.greatest(F.abs("delta_lo"), F.abs("delta_hi")))).alias("max_abs_delta"),
        rnd(F.max((F.col("test_low") + F.col("test_high")) / F.col("n_test"))).alias("max_test_share"))


@query("pre8_standardisation_check", sql_with("winsorized", f"""
WITH z AS (SELECT sample, company, roa_lag, size, (roa_lag - avg(roa_lag) OVER w) / stddev_samp(roa_lag) OVER w AS z1, (size - avg(size) OVER w) / stddev_samp(size) OVER w AS z2 FROM winsorized WINDOW w AS (PARTITION BY sample))
SELECT sample, 0.0::DOUBLE AS max_abs_difference, {r('max(abs(m1))')} AS max_abs_firm_mean_0, {r('max(abs(m2))')} AS max_abs_firm_mean_1 FROM (SELECT sample, company, avg(z1) AS m1, avg(z2) AS m2 FROM z GROUP BY ALL) GROUP BY sample"""))
def _(spark, d):
    w = winsorized(spark, d).select("sample", "company", "roa_lag", "size", F.col("roa_lag").alias("z1"), F.col("size").alias("z2"))
    z = prep.zscore(w, ["sample"], ["z1", "z2"])
    out = prep.standardisation_check(z, ["sample"], {"z1": "roa_lag", "z2": "size"})
    return out.select("sample", *cols_df(["max_abs_difference", "max_abs_firm_mean_0", "max_abs_firm_mean_1"]))


# --- comparison of two validation targets ----------------------------------------------------------------

METRICS = ["da_raw", "da_z_est", "da_z_pred"]
cte("metric_pairs", "da_joined", " UNION ALL ".join(f"SELECT sample, '{m}' AS metric, company, year, abs({m}_row) AS a, abs({m}_grouped) AS b FROM da_joined" for m in METRICS))


def matched_sql(src, keys):
    p = f"PARTITION BY {keys}"
    return f"""m0 AS (SELECT *, count(*) OVER ({p}) AS n, row_number() OVER ({p} ORDER BY a DESC, company, year) AS ra, row_number() OVER ({p} ORDER BY b DESC, company, year) AS rb,
 rank() OVER ({p} ORDER BY a) + (count(*) OVER ({p}, a) - 1) / 2.0::DOUBLE AS aa, rank() OVER ({p} ORDER BY b) + (count(*) OVER ({p}, b) - 1) / 2.0::DOUBLE AS ab FROM {src} WHERE isfinite(a) AND isfinite(b)),
m1 AS (SELECT *, CAST(greatest(1, ceil(0.05::DOUBLE * n)) AS BIGINT) AS top_n FROM m0),
m2 AS (SELECT *, ra <= top_n AS fa, rb <= top_n AS fb FROM m1),
matched AS (SELECT {keys}, max(n) AS n_joined, max(top_n) AS top_n, count_if(fa) AS a_top_n, count_if(fb) AS b_top_n, count_if(fa AND fb) AS intersection_n, count_if(fa OR fb) AS union_n, count_if(fa AND NOT fb) AS only_a_n,
 count_if(fb AND NOT fa) AS only_b_n, count_if(NOT fa AND NOT fb) AS neither_n, corr(aa, ab) AS spearman, count_if(fa AND fb) / count_if(fa OR fb)::DOUBLE AS jaccard,
 (count_if(fa AND NOT fb) + count_if(fb AND NOT fa)) / max(n)::DOUBLE AS switch_rate, max(top_n) / max(n)::DOUBLE AS effective_top_share FROM m2 GROUP BY {keys})"""


def metric_pairs(spark, d):
    j = da_joined(spark, d)
    return j.select("sample", "company", "year", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.abs(f"{m}_row").alias("a"), F.abs(f"{m}_grouped").alias("b")) for m in METRICS])))


CMP_DBL = ["spearman", "jaccard", "switch_rate", "effective_top_share"]
CMP_INT = ["n_joined", "top_n", "intersection_n", "union_n", "only_a_n", "only_b_n", "neither_n"]


@query("cmp1_matched_top_share", sql_with("metric_pairs", f"WITH {matched_sql('metric_pairs', 'sample, metric')} SELECT sample, metric, {', '.join(CMP_INT)}, {cols_sql(CMP_DBL)} FROM matched"))
def _(spark, d):
    out = C.matched_comparison(metric_pairs(spark, d), ["sample", "metric"], "a", "b")
    return out.select("sample", "metric", *CMP_INT, *cols_df(CMP_DBL))


@query("cmp2_membership", sql_with("metric_pairs", f"""WITH {matched_sql('metric_pairs', 'sample, metric')} SELECT sample, metric, company, year, ra AS rank_a, rb AS rank_b,
 CASE WHEN fa AND fb THEN 'both' WHEN fa THEN 'a_only' WHEN fb THEN 'b_only' ELSE 'neither' END AS membership_class FROM m2"""))
def _(spark, d):
    out = C.membership(metric_pairs(spark, d), ["sample", "metric"], "a", "b")
    return out.select("sample", "metric", "company", "year", "rank_a", "rank_b", "membership_class")


@query("cmp3_flag_overlap", sql_with("da_joined", f"""
SELECT sample, count(*) AS n_joined, count_if(tail95_row > 0) AS a_flag_n, count_if(tail95_grouped > 0) AS b_flag_n, count_if(tail95_row > 0 AND tail95_grouped > 0) AS intersection_n, count_if(tail95_row > 0 OR tail95_grouped > 0) AS union_n,
 count_if(tail95_row > 0 AND tail95_grouped = 0) AS only_a_n, count_if(tail95_row = 0 AND tail95_grouped > 0) AS only_b_n, {r('count_if(tail95_row > 0 AND tail95_grouped > 0) / nullif(count_if(tail95_row > 0 OR tail95_grouped > 0), 0)::DOUBLE')} AS jaccard,
 {r('count_if(tail95_row <> tail95_grouped) / count(*)::DOUBLE')} AS switch_rate FROM da_joined WHERE tail95_row IS NOT NULL AND tail95_grouped IS NOT NULL GROUP BY sample"""))
def _(spark, d):
    return C.flag_overlap(da_joined(spark, d), ["sample"], "tail95_row", "tail95_grouped").withColumns({c: rnd(c) for c in ("jaccard", "switch_rate")})


@query("cmp4_invariants", sql_with("metric_pairs", f"WITH {matched_sql('metric_pairs', 'sample, metric')} SELECT sample, metric, a_top_n = top_n AND b_top_n = top_n AND union_n = 2 * top_n - intersection_n AND neither_n = n_joined - union_n AS invariants_hold FROM matched"))
def _(spark, d):
    return C.invariants(C.matched_comparison(metric_pairs(spark, d), ["sample", "metric"], "a", "b")).select("sample", "metric", "invariants_hold")


@query("cmp5_materiality_decision", sql_with("metric_pairs", f"""WITH {matched_sql('metric_pairs', 'sample, metric')} SELECT sample, count(*) AS n_metrics, {r('min(jaccard)')} AS min_jaccard,
 CASE WHEN bool_or(jaccard < 0.6) THEN 'WARN_PRIMARY_MAGNITUDE_JACCARD_LOW' WHEN bool_or(jaccard < 0.8) THEN 'WARN_PRIMARY_MAGNITUDE_JACCARD_MODERATE' ELSE 'PASS_PRIMARY_MAGNITUDE_RECLASSIFICATION_AVAILABLE' END AS decision
 FROM matched WHERE metric <> 'da_z_pred' GROUP BY sample"""))
def _(spark, d):
    m = C.matched_comparison(metric_pairs(spark, d).filter("metric <> 'da_z_pred'"), ["sample", "metric"], "a", "b")
    return C.primary_decision(m, ["sample"]).withColumn("min_jaccard", rnd("min_jaccard"))


def den_sql():
    q = ", ".join(f"quantile_cont(nda_sd_epred_{s}, {p}) AS {n}_{s}" for s in ("row", "grouped") for n, p in (("p01", 0.01), ("p05", 0.05), ("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
    def v(s):
        x = f"nda_sd_epred_{s}"
        return {"original": x, "winsor_1_99": f"least(greatest({x}, p01_{s}), p99_{s})", "winsor_5_95": f"least(greatest({x}, p05_{s}), p95_{s})",
                "floor_p01": f"greatest({x}, p01_{s})", "floor_p05": f"greatest({x}, p05_{s})", "median": f"p50_{s}"}
    a, b = v("row"), v("grouped")
    u = " UNION ALL ".join(f"SELECT sample, '{k}' AS denominator, company, year, abs(da_raw_row / {a[k]}) AS a, abs(da_raw_grouped / {b[k]}) AS b FROM jq" for k in a)
    return f"jq AS (SELECT * FROM da_joined JOIN (SELECT sample, {q} FROM da_joined GROUP BY sample) USING (sample)), dv AS ({u}), {matched_sql('dv', 'sample, denominator')}"


def den_inputs(spark, d):
    return da_joined(spark, d).select("sample", "company", "year", F.col("da_raw_row").alias("raw_a"), F.col("da_raw_grouped").alias("raw_b"),
                                      F.col("nda_sd_epred_row").alias("den_a"), F.col("nda_sd_epred_grouped").alias("den_b"))


@query("cmp6_denominator_perturbed_jaccard", sql_with("da_joined", f"WITH {den_sql()} SELECT sample, denominator, {', '.join(CMP_INT)}, {cols_sql(['jaccard', 'switch_rate'])} FROM matched"))
def _(spark, d):
    out = C.denominator_perturbed(den_inputs(spark, d), ["sample"])
    return out.select("sample", "denominator", *CMP_INT, *cols_df(["jaccard", "switch_rate"]))


@query("cmp6_denominator_decision", sql_with("da_joined", f"""WITH {den_sql()}, o AS (SELECT sample, max(CASE WHEN denominator = 'original' THEN jaccard END) AS oj, min(CASE WHEN denominator <> 'original' THEN jaccard END) AS lo,
 max(CASE WHEN denominator <> 'original' THEN jaccard END) AS hi FROM matched GROUP BY sample)
SELECT sample, {r('oj')} AS original_jaccard, {r('lo')} AS min_jaccard, {r('hi')} AS max_jaccard, {r('hi - lo')} AS jaccard_range, {r('hi - oj')} AS max_increase, hi - oj >= 0.2 AS denominator_sensitive,
 oj < 0.6 AND hi >= 0.8 AS denominator_driven, CASE WHEN oj < 0.6 AND hi >= 0.8 THEN 'FAIL_DENOMINATOR_DRIVEN' WHEN hi - oj >= 0.2 THEN 'WARN_DENOMINATOR_SENSITIVE' ELSE 'PASS_DENOMINATOR_DIAGNOSTIC_STABLE' END AS assessment FROM o"""))
def _(spark, d):
    out = C.denominator_decision(C.denominator_perturbed(den_inputs(spark, d), ["sample"]), ["sample"])
    return out.withColumns({c: rnd(c) for c in ("original_jaccard", "min_jaccard", "max_jaccard", "jaccard_range", "max_increase")})


@query("cmp7_two_score_definitions", sql_with("da", f"""WITH l AS (SELECT scheme, sample, company, year, abs(da_z_est) AS a, abs(da_z_pred) AS b FROM da), {matched_sql('l', 'scheme, sample')},
pe AS (SELECT scheme, sample, corr(a, b) AS pearson FROM l GROUP BY scheme, sample)
SELECT scheme, sample, {', '.join(CMP_INT)}, {cols_sql(['spearman', 'jaccard', 'pearson'])} FROM matched JOIN pe USING (scheme, sample)"""))
def _(spark, d):
    from firmlens.operators.aggregates import pearson

    l = da_table(spark, d).select("scheme", "sample", "company", "year", F.abs("da_z_est").alias("a"), F.abs("da_z_pred").alias("b"))
    out = C.matched_comparison(l, ["scheme", "sample"], "a", "b").join(pearson(l, ["scheme", "sample"], "a", "b").drop("n"), ["scheme", "sample"])
    return out.select("scheme", "sample", *CMP_INT, *cols_df(["spearman", "jaccard", "pearson"]))


@query("cmp8_baseline_vs_variant", sql_with("metric_pairs da", f"""WITH {matched_sql('metric_pairs', 'sample, metric')}, bse AS (SELECT sample, metric, jaccard FROM matched WHERE metric <> 'da_z_pred'),
pv AS (SELECT r.sample, m.metric, r.company, r.year, CASE WHEN m.metric = 'da_raw' THEN r.firm_train_rows * abs(r.da_raw) ELSE abs(r.da_z_pred) END AS a, CASE WHEN m.metric = 'da_raw' THEN abs(g.da_raw) ELSE abs(g.da_z_pred) END AS b
 FROM (SELECT * FROM da WHERE scheme = 'row') r JOIN (SELECT * FROM da WHERE scheme = 'grouped') g USING (sample, company, year) CROSS JOIN (VALUES ('da_raw'), ('da_z_est')) m(metric)),
{matched_sql('pv', 'sample, metric').replace('m0', 'v0').replace('m1', 'v1').replace('m2', 'v2').replace('matched', 'vmatched')}
SELECT sample AS target_space, metric, {r('v.jaccard')} AS variant_jaccard, {r('b.jaccard')} AS baseline_jaccard, {r('v.jaccard - b.jaccard')} AS difference, b.jaccard < 0.8 AS baseline_material, v.jaccard < 0.8 AS variant_material,
 (b.jaccard < 0.8) = (v.jaccard < 0.8) AS conclusion_unchanged, CASE WHEN v.jaccard >= 0.8 THEN 'FAIL' WHEN (b.jaccard < 0.8) <> (v.jaccard < 0.8) OR abs(v.jaccard - b.jaccard) > 0.1 THEN 'WARN' ELSE 'PASS' END AS decision
FROM vmatched v JOIN bse b USING (sample, metric)"""))
def _(spark, d):
    from firmlens.session import materialise

    base = C.matched_comparison(metric_pairs(spark, d).filter("metric <> 'da_z_pred'"), ["sample", "metric"], "a", "b")
    da = da_table(spark, d)
    side = lambda s, p: da.filter(F.col("scheme") == s).select("sample", "company", "year", F.col("firm_train_rows").alias(f"{p}n"), F.abs("da_raw").alias(f"{p}raw"), F.abs("da_z_pred").alias(f"{p}z"))
    j = side("row", "r").join(side("grouped", "g"), ["sample", "company", "year"])
    pairs = j.select("sample", "company", "year", F.inline(F.array(
        F.struct(F.lit("da_raw").alias("metric"), (F.col("rn") * F.col("rraw")).alias("a"), F.col("graw").alias("b")),
        F.struct(F.lit("da_z_est").alias("metric"), F.col("rz").alias("a"), F.col("gz").alias("b")))))
    var = C.matched_comparison(pairs, ["sample", "metric"], "a", "b")
    ren = lambda df: materialise(df.select(F.col("sample").alias("target_space"), "metric", "jaccard"), "jaccard")
    out = C.compare_with_baseline(ren(var), ren(base))
    return out.withColumns({c: rnd(c) for c in ("variant_jaccard", "baseline_jaccard", "difference")})


@query("cmp10_jaccard_decomposition", sql_with("da_joined", f"""WITH l AS (SELECT sample, 'own' AS pair, company, year, abs(da_raw_row / nda_sd_epred_row) AS a, abs(da_raw_grouped / nda_sd_epred_grouped) AS b FROM da_joined
 UNION ALL SELECT sample, 'same_denominator', company, year, abs(da_raw_row / nda_sd_epred_row), abs(da_raw_grouped / nda_sd_epred_row) FROM da_joined
 UNION ALL SELECT sample, 'same_numerator', company, year, abs(da_raw_row / nda_sd_epred_row), abs(da_raw_row / nda_sd_epred_grouped) FROM da_joined), {matched_sql('l', 'sample, pair')}
SELECT sample, pair, {', '.join(CMP_INT)}, {cols_sql(['jaccard', 'spearman'])} FROM matched"""))
def _(spark, d):
    out = C.jaccard_decomposition(den_inputs(spark, d), ["sample"])
    return out.select("sample", "pair", *CMP_INT, *cols_df(["jaccard", "spearman"]))


@query("cmp10_class_profile_medians", sql_with("metric_pairs da_joined", f"""WITH {matched_sql('metric_pairs', 'sample, metric')}, c AS (SELECT m2.sample, CASE WHEN fa AND fb THEN 'both' WHEN fa THEN 'a_only' WHEN fb THEN 'b_only' ELSE 'neither' END AS membership_class, nda_sd_epred_row AS sr, nda_sd_epred_grouped AS sg
 FROM m2 JOIN da_joined USING (sample, company, year) WHERE metric = 'da_z_est')
SELECT sample, membership_class, count(*) AS n, {r('quantile_cont(sr, 0.5)')} AS median_sd_row, {r('quantile_cont(sg, 0.5)')} AS median_sd_grouped FROM c GROUP BY sample, membership_class"""))
def _(spark, d):
    from firmlens.operators.ordered import quantiles

    m = C.membership(metric_pairs(spark, d).filter("metric = 'da_z_est'"), ["sample", "metric"], "a", "b").select("sample", "company", "year", "membership_class")
    j = m.join(da_joined(spark, d).select("sample", "company", "year", F.col("nda_sd_epred_row").alias("sr"), F.col("nda_sd_epred_grouped").alias("sg")), ["sample", "company", "year"])
    q = quantiles(j, ["sample", "membership_class"], ["sr", "sg"], [0.5])
    pick = lambda v: rnd(F.max(F.when(F.col("variable") == v, F.col("q")[0])))
    return q.groupBy("sample", "membership_class").agg(F.max("n").alias("n"), pick("sr").alias("median_sd_row"), pick("sg").alias("median_sd_grouped"))
