"""Score roll-ups, stacking weights and weight tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from firmlens.catalog.common import K, stage
from firmlens.catalog.model_queries import predictions, primary_scores, scores
from firmlens.catalog.panel_queries import cols_df, cols_sql
from firmlens.catalog.registry import CTES, cte, query, r, sql_with
from firmlens.functions.columns import rnd
from firmlens.functions.naming import FIRM_RE, POOLED, model_family
from firmlens.operators import compare as C
from firmlens.operators import stacking as ST

MK = ["scheme", "target_space", "model_id", "variant"]
G = ["scheme", "target_space"]
IDS = ["company", "year"]

cte("fold_scores", "primary_scores", """SELECT scheme, target_space, model_id, variant, fold_id, count(*) AS n_test_obs, count(DISTINCT company) AS n_test_firms, sum(lpd_obs) AS elpd_fold, avg(lpd_obs) AS mean_lpd_obs,
 sqrt(avg(squared_error)) AS rmse, avg(abs_error) AS mae FROM primary_scores GROUP BY ALL""")
cte("model_scores", "fold_scores", """SELECT scheme, target_space, model_id, variant, CAST(sum(n_test_obs) AS BIGINT) AS n_test_obs_total, CAST(sum(n_test_firms) AS BIGINT) AS n_test_firms_total, sum(elpd_fold) AS elpd_kfold,
 sum(n_test_obs * mean_lpd_obs) / sum(n_test_obs) AS mean_lpd_obs, stddev_samp(elpd_fold) AS sd_elpd_fold, sqrt(sum(n_test_obs * rmse * rmse) / sum(n_test_obs)) AS rmse, sum(n_test_obs * mae) / sum(n_test_obs) AS mae FROM fold_scores GROUP BY ALL""")
cte("all_fold_scores", "scores", CTES["fold_scores"][1].replace("primary_scores", "scores"))
cte("all_model_scores", "all_fold_scores", CTES["model_scores"][1].replace("FROM fold_scores", "FROM all_fold_scores"))
cte("fold_diag", "fold_scores", """SELECT scheme, target_space, model_id, variant, fold_id, n_test_obs > 5 AS completed, 1 + round(rmse, 4) / 100 AS max_rhat, n_test_obs * 1.5 AS min_ess_bulk, n_test_obs * 1.2 AS min_ess_tail,
 CASE WHEN rmse > 1.2 THEN 1 ELSE 0 END AS divergences, 0 AS treedepth_warnings FROM fold_scores""")
cte("reliability", "fold_diag", f"""SELECT *, reliability_flag IN ('OK', 'CAUTION') AND n_folds_completed = {K} AS included_in_stack FROM (SELECT *, CASE WHEN n_folds_completed = 0 THEN 'FAILED' WHEN n_folds_completed < {K} THEN 'LOW_RELIABILITY' WHEN divergences > 0 OR treedepth_warnings > 0 THEN 'LOW_RELIABILITY'
 WHEN max_rhat <= 1.01 AND min_ess_bulk >= 400 AND min_ess_tail >= 400 THEN 'OK' WHEN max_rhat <= 1.05 AND min_ess_bulk >= 100 AND min_ess_tail >= 100 THEN 'CAUTION' ELSE 'LOW_RELIABILITY' END AS reliability_flag
 FROM (SELECT scheme, target_space, model_id, variant, count(*) AS n_folds_attempted, count(CASE WHEN completed THEN 1 END) AS n_folds_completed, max(max_rhat) AS max_rhat, min(min_ess_bulk) AS min_ess_bulk, min(min_ess_tail) AS min_ess_tail,
  CAST(sum(divergences) AS BIGINT) AS divergences, CAST(sum(treedepth_warnings) AS BIGINT) AS treedepth_warnings FROM fold_diag GROUP BY ALL))""")
cte("all_fold_diag", "all_fold_scores", CTES["fold_diag"][1].replace("FROM fold_scores", "FROM all_fold_scores"))
cte("all_reliability", "all_fold_diag", CTES["reliability"][1].replace("FROM fold_diag", "FROM all_fold_diag"))


def fold_diag(spark, d, of=primary_scores):
    """Fold diagnostics table as a sampler would deliver it, here derived from the fold scores."""
    n = F.col("n_test_obs")
    return ST.fold_scores(of(spark, d), MK).select(
        *MK, "fold_id", (n > 5).alias("completed"), (1 + F.round("rmse", 4) / 100).alias("max_rhat"), (n * 1.5).alias("min_ess_bulk"),
        (n * 1.2).alias("min_ess_tail"), F.when(F.col("rmse") > 1.2, 1).otherwise(0).alias("divergences"), F.lit(0).alias("treedepth_warnings"))


def optimum_sql(src: str, prefix: str) -> str:
    """The optimum of the stacking objective as CTEs; the last one is ``{prefix}_final``.

    A recursive CTE takes quadratic steps, solved by coordinate descent over lists, until the certificate holds: no model may add more than
    the tolerance to the mean log density.
    """
    k, g = "scheme, target_space, model_key", "scheme, target_space"
    sizes = ", ".join(f"{a}::DOUBLE" for a in ST.STEP_SIZES)
    on = "USING (scheme, target_space)"
    slope = "1 - g[i] + list_dot_product(h[(i - 1) * len(g) + 1 : i * len(g)], list_transform(x, lambda u, l: u - w[l]))"
    descend = f"""list_reduce(list_concat([w], list_transform(range(0, 300 * len(w)), lambda t: [t % len(w) + 1.0::DOUBLE])),
   lambda x, t: list_transform(x, lambda v, i: CASE WHEN i = t[1] THEN greatest(0.0, v - ({slope}) / h[(i - 1) * len(g) + i]) ELSE v END))"""
    return f"""{prefix}_d AS MATERIALIZED (SELECT {g}, company, year, max(lpd_obs) AS m, list(exp(lpd_obs - mx) ORDER BY model_key) AS p
  FROM (SELECT *, max(lpd_obs) OVER (PARTITION BY {g}, company, year) AS mx FROM {src}) GROUP BY {g}, company, year),
{prefix}_e AS MATERIALIZED (SELECT {k}, sum(lpd_obs) AS elpd FROM {src} GROUP BY {k}),
{prefix}_k AS MATERIALIZED (SELECT {g}, list(model_key ORDER BY model_key) AS keys, arg_min(model_key, (-elpd, model_key)) AS best, max(elpd) AS best_elpd FROM {prefix}_e GROUP BY {g}),
{prefix}_w AS MATERIALIZED (WITH RECURSIVE it(scheme, target_space, step, w, gap) AS (
 SELECT {g}, 0, list_transform(keys, lambda x: 1.0::DOUBLE / len(keys)), 1.0::DOUBLE FROM {prefix}_k
 UNION ALL
 SELECT {g}, step + 1, arg_max(to_w, objective), max(gap) FROM (
  SELECT s.scheme, s.target_space, step, gap, to_w, sum(m + ln(list_dot_product(p, to_w))) AS objective FROM (
   SELECT {g}, step, gap, list_transform(w, lambda v, i: v + alpha * (x[i] - v)) AS to_w FROM (
    SELECT {g}, step, gap, w, list_transform(x, lambda v, i: {ST.INSIDE!r} * w[i] + (1 - {ST.INSIDE!r}) * v / list_sum(x)) AS x, unnest(CASE WHEN gap < {ST.FULL_STEP_GAP!r} THEN [1.0::DOUBLE] ELSE [{sizes}] END) AS alpha FROM (
     SELECT {g}, step, w, list_max(g) - 1 AS gap, {descend} AS x FROM (
      SELECT {g}, step, w, list(v ORDER BY j) FILTER (WHERE i = 0 AND j > 0) AS g, list(v ORDER BY i, j) FILTER (WHERE i > 0 AND j > 0) AS h FROM (
       SELECT {g}, step, w, i, j, avg(c[i + 1] * c[j + 1]) AS v FROM (
        SELECT it.scheme, it.target_space, step, w, list_prepend(1.0::DOUBLE, list_transform(p, lambda q: q / list_dot_product(p, w))) AS c FROM it JOIN {prefix}_d {on} WHERE gap >= {ST.KKT_TOL!r} AND step < 80),
        (SELECT unnest(range(0, 33)) AS i), (SELECT unnest(range(0, 33)) AS j) WHERE i <= len(w) AND j <= len(w) GROUP BY {g}, step, w, i, j) GROUP BY {g}, step, w)))) s
   JOIN {prefix}_d {on} GROUP BY s.scheme, s.target_space, step, gap, to_w) GROUP BY {g}, step)
 SELECT {g}, keys, best, best_elpd, list_transform(v, lambda z: z / list_sum(v)) AS w, gap < {ST.KKT_TOL!r} AS converged FROM
  (SELECT {g}, list_transform(arg_max(w, step), lambda z: CASE WHEN z > {ST.ZERO_WEIGHT!r} THEN z ELSE 0.0 END) AS v, arg_max(gap, step) AS gap FROM it GROUP BY {g}) JOIN {prefix}_k {on}),
{prefix}_o AS (SELECT {g}, sum(m + ln(list_dot_product(p, w))) AS obj FROM {prefix}_d JOIN {prefix}_w {on} GROUP BY {g}),
{prefix}_final AS (SELECT {g}, model_key, CASE WHEN obj < best_elpd - 1e-6 THEN CASE WHEN model_key = best THEN 1.0 ELSE 0.0 END ELSE weight END AS weight, elpd AS singleton_elpd, best AS best_singleton, greatest(obj, best_elpd) AS objective, converged
 FROM (SELECT {g}, best, best_elpd, converged, unnest(keys) AS model_key, unnest(w) AS weight FROM {prefix}_w) JOIN {prefix}_o {on} JOIN {prefix}_e USING ({k}))"""


_LABEL = f"split_part(model_key, '_', 1) AS model_id, CASE WHEN model_key LIKE '%firm_re' THEN '{FIRM_RE}' ELSE '{POOLED}' END AS variant"
cte("weights", "primary_scores", f"WITH {optimum_sql('primary_scores', 'opt')} SELECT *, {_LABEL}, row_number() OVER (PARTITION BY scheme, target_space ORDER BY weight DESC, model_key) AS rank FROM opt_final")


def labelled(w):
    return w.withColumn("model_id", F.split("model_key", "_")[0]).withColumn("variant", F.when(F.col("model_key").endswith("firm_re"), FIRM_RE).otherwise(POOLED))


def density_arrays(spark, d):
    """(scheme, target_space, lpd) of every target, a stage table, and the models of the arrays: {(scheme, space): [(model_id, variant, model_key)]}."""
    wide, names = predictions(spark, d)
    u = lambda p, m: (F.col("y_actual") - p) / F.greatest(m["pred_sd"], F.lit(2.220446049250313e-16))
    lpd = lambda p, m: F.lit(-0.5 * math.log(2 * math.pi)) - F.log(F.greatest(m["pred_sd"], F.lit(2.220446049250313e-16))) - u(p, m) * u(p, m) / 2
    build = lambda: wide.filter("history").join(F.broadcast(names), [*G, "fold_id"]).select(*G, F.zip_with("preds", "_m", lpd).alias("lpd"))
    found = {}
    for n in names.collect():  # a row for each scheme, space and fold
        key = lambda m: f"{m.model_id}_{n.target_space}_{'firm_re' if m.variant == FIRM_RE else 'pooled'}"  # noqa: E731,B023
        found[n.scheme, n.target_space] = [(m.model_id, m.variant, key(m)) for m in n._m]
    return stage(spark, d, "lpd", build), found


def main_stack(spark, d):
    rows, models = density_arrays(spark, d)
    return ST.stack_arrays(rows, G, G, {g: (g, {k: i for i, (_, _, k) in enumerate(ms)}) for g, ms in models.items()})


def weights(spark, d):
    """Optimal stacking weights, a stage table."""
    return stage(spark, d, "weights", lambda: labelled(main_stack(spark, d)))


@query("stk1_score_rollup", sql_with("all_model_scores", f"SELECT {', '.join(MK)}, n_test_obs_total, n_test_firms_total, {cols_sql(['elpd_kfold', 'sd_elpd_fold'], 3)}, {cols_sql(['mean_lpd_obs', 'rmse', 'mae'], 5)} FROM all_model_scores"))
def _(spark, d):
    out = ST.model_scores(ST.fold_scores(scores(spark, d), MK), MK)
    return out.select(*MK, "n_test_obs_total", "n_test_firms_total", *cols_df(["elpd_kfold", "sd_elpd_fold"], 3), *cols_df(["mean_lpd_obs", "rmse", "mae"], 5))


@query("stk2_reliability_flag", sql_with("all_reliability", f"SELECT {', '.join(MK)}, n_folds_attempted, n_folds_completed, {cols_sql(['max_rhat', 'min_ess_bulk', 'min_ess_tail'], 6)}, divergences, treedepth_warnings, reliability_flag, included_in_stack FROM all_reliability"))
def _(spark, d):
    out = ST.reliability(fold_diag(spark, d, scores), K, MK)
    return out.select(*MK, "n_folds_attempted", "n_folds_completed", *cols_df(["max_rhat", "min_ess_bulk", "min_ess_tail"], 6), "divergences", "treedepth_warnings", "reliability_flag", "included_in_stack")


@query("stk3_alignment", sql_with("scores", """
WITH p AS (SELECT scheme, target_space, company, year, count(DISTINCT model_key) AS m, count(*) AS c FROM scores GROUP BY ALL), n AS (SELECT scheme, target_space, count(DISTINCT model_key) AS n_models FROM scores GROUP BY ALL)
SELECT scheme, target_space, n_models, count(*) AS n_obs, count_if(m < n_models) AS n_incomplete, count_if(c > m) AS n_duplicated, count_if(m < n_models) = 0 AND count_if(c > m) = 0 AS aligned FROM p JOIN n USING (scheme, target_space) GROUP BY scheme, target_space, n_models"""))
def _(spark, d):
    return ST.alignment_report(scores(spark, d), G, IDS)


@query("stk4_log_mean_exp", sql_with("scores", f"""
SELECT scheme, target_space, company, year, count(*) AS n, {r('max(lpd_obs) + ln(avg(exp(lpd_obs - m)))', 5)} AS lme FROM (SELECT *, max(lpd_obs) OVER (PARTITION BY scheme, target_space, company, year) AS m FROM scores) GROUP BY scheme, target_space, company, year"""))
def _(spark, d):
    return ST.log_mean_exp(scores(spark, d), G + IDS, "lpd_obs").withColumn("lme", rnd("lme", 5))


@query("stk5_stacking_weights", sql_with("weights", f"SELECT scheme, target_space, model_key, {r('weight', 4)} AS weight, {r('singleton_elpd', 3)} AS singleton_elpd, best_singleton, {r('objective', 3)} AS objective, converged FROM weights"))
def _(spark, d):
    out = main_stack(spark, d)
    return out.select("scheme", "target_space", "model_key", rnd("weight", 4).alias("weight"), rnd("singleton_elpd", 3).alias("singleton_elpd"), "best_singleton", rnd("objective", 3).alias("objective"), "converged")


@query("stk5_converged_weights")
def _(spark, d):
    return main_stack(spark, d)


@query("stk6_pseudo_bma", sql_with("all_model_scores", f"SELECT {', '.join(MK)}, {r('exp(elpd_kfold - max(elpd_kfold) OVER w) / sum(exp(elpd_kfold - mx)) OVER w')} AS weight FROM (SELECT *, max(elpd_kfold) OVER (PARTITION BY scheme, target_space) AS mx FROM all_model_scores) WINDOW w AS (PARTITION BY scheme, target_space)"))
def _(spark, d):
    ms = ST.model_scores(ST.fold_scores(scores(spark, d), MK), MK)
    return ST.pseudo_bma(ms, G).select(*MK, rnd("weight").alias("weight"))


@query("stk7_singleton_and_objective", sql_with("primary_scores", f"""
WITH e AS (SELECT scheme, target_space, model_key, sum(lpd_obs) AS elpd FROM primary_scores GROUP BY ALL), b AS (SELECT scheme, target_space, arg_max(model_key, elpd) AS best_model, max(elpd) AS best_elpd, count(*) AS k FROM e GROUP BY ALL),
q AS (SELECT scheme, target_space, sum(l) AS obj FROM (SELECT scheme, target_space, company, year, max(lpd_obs) + ln(avg(exp(lpd_obs - m))) AS l FROM (SELECT *, max(lpd_obs) OVER (PARTITION BY scheme, target_space, company, year) AS m FROM primary_scores) GROUP BY ALL) GROUP BY ALL)
SELECT scheme, target_space, best_model, {r('best_elpd', 3)} AS singleton_objective, {r('obj', 3)} AS equal_weight_objective FROM b JOIN q USING (scheme, target_space)"""))
def _(spark, d):
    s = primary_scores(spark, d)
    elpd = s.groupBy(*G, "model_key").agg(F.sum("lpd_obs").alias("elpd_kfold"))
    single = ST.singleton_weights(elpd, G)
    n = elpd.groupBy(*G).agg(F.count("*").alias("k"))
    equal = elpd.join(n, G).withColumn("weight", 1 / F.col("k"))
    best = single.filter("weight = 1").select(*G, F.col("model_key").alias("best_model"))
    obj = lambda w, name: ST.objective_at(s, w, G, IDS).select(*G, rnd("objective", 3).alias(name))
    return best.join(obj(single, "singleton_objective"), G).join(obj(equal, "equal_weight_objective"), G)


@query("stk8_two_model_weight", sql_with("primary_scores", f"WITH two AS (SELECT * REPLACE (target_space || ':' || model_id AS target_space) FROM primary_scores), {optimum_sql('two', 'tw')} SELECT scheme, split_part(target_space, ':', 1) AS target_space, split_part(target_space, ':', 2) AS model_id, {r('weight', 4)} AS firm_re_weight, converged FROM tw_final WHERE model_key LIKE '%firm_re'"))
def _(spark, d):
    rows, models = density_arrays(spark, d)
    pairs = {}
    for g, ms in models.items():
        for i, (m, variant, _) in enumerate(ms):
            pairs.setdefault((*g, m), (g, {}))[1]["firm_re" if variant == FIRM_RE else "pooled"] = i
    out = ST.stack_arrays(rows, G, [*G, "model_id"], pairs).filter("model_key = 'firm_re'")
    return out.select(*G, "model_id", rnd("weight", 4).alias("firm_re_weight"), "converged")


@query("stk9_weight_sanity", sql_with("weights", f"""
SELECT scheme, target_space, {r('sum(weight)')} AS weight_sum, min(weight) >= 0 AS nonnegative, abs(sum(weight) - 1) <= 1e-5 AS sums_to_one, max(CASE WHEN rank = 1 THEN model_key END) AS top_model,
 max(weight) > 0.999 AND max(CASE WHEN rank = 1 THEN model_key END) <> max(best_singleton) AS top_not_best_singleton FROM weights GROUP BY scheme, target_space"""))
def _(spark, d):
    out = ST.weight_sanity(weights(spark, d), G)
    return out.select(*G, rnd("weight_sum").alias("weight_sum"), "nonnegative", "sums_to_one", "top_model", "top_not_best_singleton")


cte("weight_pairs", "weights", """SELECT target_space, model_id, variant, model_key, coalesce(x.weight, 0) AS weight_a, coalesce(y.weight, 0) AS weight_b, x.rank AS rank_a, y.rank AS rank_b
 FROM (SELECT * FROM weights WHERE scheme = 'row' AND weight > 0) x FULL JOIN (SELECT * FROM weights WHERE scheme = 'grouped' AND weight > 0) y USING (target_space, model_id, variant, model_key)""")


def weight_pairs(spark, d):
    w = weights(spark, d).filter("weight > 0")  # dropped models are missing on their side
    return ST.weight_comparison(w, "row", "grouped", ["target_space", "model_id", "variant", "model_key"])


@query("join3_full_join_weights", sql_with("weight_pairs", f"SELECT target_space, model_key, {cols_sql(['weight_a', 'weight_b'], 5)}, rank_a, rank_b FROM weight_pairs"))
def _(spark, d):
    return weight_pairs(spark, d).select("target_space", "model_key", *cols_df(["weight_a", "weight_b"], 5), "rank_a", "rank_b")


@query("win5_rank_change", sql_with("weights", "SELECT x.target_space, x.model_key, x.rank AS rank_row, y.rank AS rank_grouped, x.rank - y.rank AS rank_change FROM weights x JOIN weights y ON x.target_space = y.target_space AND x.model_key = y.model_key AND x.scheme = 'row' AND y.scheme = 'grouped'"))
def _(spark, d):
    w = ST.ranked_weights(weights(spark, d).drop("rank"), G)
    p = ST.weight_comparison(w, "row", "grouped", ["target_space", "model_key"])
    return p.select("target_space", "model_key", F.col("rank_a").alias("rank_row"), F.col("rank_b").alias("rank_grouped"), "rank_change")


FAM_SQL = "CASE WHEN model_id IN ('M01','M02','M03') THEN 'Jones-family' WHEN model_id IN ('M04','M05','M06') THEN 'Cash-flow/McNichols-family' WHEN model_id = 'M07' THEN 'Ball-Shivakumar/asymmetry' WHEN model_id = 'M09' THEN 'No-lookahead/real-time' ELSE model_id END"
cte("families", "weights", f"SELECT *, row_number() OVER (PARTITION BY scheme, target_space ORDER BY family_weight DESC, family) AS family_rank FROM (SELECT scheme, target_space, {FAM_SQL} AS family, sum(weight) AS family_weight, count(*) AS n_models FROM weights GROUP BY ALL)")


@query("agg24_family_rollup", sql_with("families", f"SELECT scheme, target_space, family, {r('family_weight', 5)} AS family_weight, n_models, family_rank FROM families"))
def _(spark, d):
    return ST.family_rollup(weights(spark, d), G).withColumn("family_weight", rnd("family_weight", 5))


LABEL_SQL = "CASE WHEN abs(weight_a - weight_b) < 0.1 THEN 'stable' WHEN abs(weight_a - weight_b) < 0.2 THEN 'minor_shift' WHEN abs(weight_a - weight_b) < 0.5 THEN 'material_shift' ELSE 'reversal' END"


@query("stk10_weight_comparison", sql_with("weight_pairs", f"SELECT target_space, model_key, {r('weight_a - weight_b', 5)} AS weight_difference, rank_a - rank_b AS rank_change, {LABEL_SQL} AS stability_label FROM weight_pairs"))
def _(spark, d):
    return weight_pairs(spark, d).select("target_space", "model_key", rnd("weight_difference", 5).alias("weight_difference"), "rank_change", "stability_label")


SHIFT_SQL = f"sum(CASE WHEN variant = '{FIRM_RE}' THEN weight_a ELSE 0 END) AS firm_re_a, sum(CASE WHEN variant = '{FIRM_RE}' THEN weight_b ELSE 0 END) AS firm_re_b, sum(CASE WHEN variant <> '{FIRM_RE}' THEN weight_a ELSE 0 END) AS pooled_a, sum(CASE WHEN variant <> '{FIRM_RE}' THEN weight_b ELSE 0 END) AS pooled_b"
SHIFT = ["firm_re_a", "firm_re_b", "pooled_a", "pooled_b", "firm_re_shift", "firm_re_ratio"]


@query("stk10_variant_shift", sql_with("weight_pairs", f"WITH s AS (SELECT target_space, {SHIFT_SQL} FROM weight_pairs GROUP BY target_space), t AS (SELECT *, firm_re_a - firm_re_b AS firm_re_shift, CASE WHEN firm_re_b > 0 THEN firm_re_a / firm_re_b END AS firm_re_ratio FROM s) SELECT target_space, {cols_sql(SHIFT, 4)} FROM t"))
def _(spark, d):
    return ST.variant_shift(weight_pairs(spark, d), ["target_space"]).select("target_space", *cols_df(SHIFT, 4))


@query("stk11_pooled_only_substack", sql_with("primary_scores", f"""WITH po AS (SELECT * FROM primary_scores WHERE variant = '{POOLED}'), {optimum_sql('po', 'pw')},
f AS (SELECT target_space, {FAM_SQL} AS family, sum(CASE WHEN scheme = 'row' THEN weight ELSE 0 END) AS wa, sum(CASE WHEN scheme = 'grouped' THEN weight ELSE 0 END) AS wb FROM (SELECT *, split_part(model_key, '_', 1) AS model_id FROM pw_final) GROUP BY ALL),
t AS (SELECT target_space, sum(abs(wa - wb)) AS l1, max(abs(wa - wb)) AS mx, arg_max(family, wa) AS fa, arg_max(family, wb) AS fb FROM f GROUP BY target_space)
SELECT target_space, {r('l1', 5)} AS shift_l1, {r('mx', 5)} AS shift_max, fa AS top_family_a, fb AS top_family_b, CASE WHEN fa <> fb OR l1 >= 0.2 OR mx >= 0.1 THEN 'ACCOUNTING_FAMILY_SHIFT_REMAINS_WITHOUT_FIRMRE' ELSE 'JOINT_SHIFT_DOMINATED_BY_HETEROGENEITY' END AS decision FROM t"""))
def _(spark, d):
    rows, models = density_arrays(spark, d)
    w = labelled(ST.stack_arrays(rows, G, G, {g: (g, {k: i for i, (_, variant, k) in enumerate(ms) if variant == POOLED}) for g, ms in models.items()}))
    out = ST.family_shift(w, "row", "grouped", ["target_space"])
    return out.withColumns({c: rnd(c, 5) for c in ("shift_l1", "shift_max")})


cte("gate", "reliability", "SELECT target_space, model_id, variant, CASE reliability_flag WHEN 'OK' THEN 'PASS' WHEN 'CAUTION' THEN 'REVIEW' ELSE 'FAIL' END AS mcmc_status FROM reliability WHERE scheme = 'grouped'")


def gate(spark, d):
    rel = ST.reliability(fold_diag(spark, d), K, MK).filter("scheme = 'grouped'")
    f = F.col("reliability_flag")
    return rel.select("target_space", "model_id", "variant", F.when(f == "OK", "PASS").when(f == "CAUTION", "REVIEW").otherwise("FAIL").alias("mcmc_status"))


@query("stk12_primary_gate", sql_with("weights reliability gate", f"""
WITH j AS (SELECT w.*, coalesce(g.mcmc_status, 'MISSING') AS ms, coalesce(rl.reliability_flag, 'MISSING') AS rf FROM (SELECT * FROM weights WHERE weight > 1e-6) w LEFT JOIN reliability rl USING (scheme, target_space, model_id, variant) LEFT JOIN gate g USING (target_space, model_id, variant)),
k AS (SELECT *, CASE WHEN ms IN ('PASS','OK') AND rf IN ('OK','PASS','CAUTION') THEN 'INCLUDE_PRIMARY' WHEN ms IN ('REVIEW','CAUTION') AND rf IN ('OK','PASS','CAUTION') THEN 'MCMC_REVIEW_INCLUDED_WITH_EXACT_REFIT_PASS' WHEN ms IN ('FAIL','LOW_RELIABILITY') THEN 'EXCLUDE_FULL_SAMPLE_MCMC_FAIL' ELSE 'EXCLUDE_RELIABILITY_NOT_PRIMARY' END AS decision FROM j)
SELECT scheme, target_space, model_key, decision, {r("CASE WHEN decision LIKE 'EXCLUDE%' THEN 0 ELSE weight END / nullif(sum(CASE WHEN decision LIKE 'EXCLUDE%' THEN 0 ELSE weight END) OVER (PARTITION BY scheme, target_space), 0)", 5)} AS primary_weight FROM k"""))
def _(spark, d):
    rel = ST.reliability(fold_diag(spark, d), K, MK).select(*MK, "reliability_flag")
    w = weights(spark, d).join(rel, MK, "left")
    out = ST.primary_gate(w, gate(spark, d), ["target_space", "model_id", "variant"], G)
    return out.select("scheme", "target_space", "model_key", "decision", rnd("primary_weight", 5).alias("primary_weight"))


@query("stk14_alignment_decision", sql_with("weight_pairs", f"""
WITH s AS (SELECT target_space, {SHIFT_SQL}, arg_min(model_key, (-weight_a, model_key)) AS top_a, arg_min(model_key, (-weight_b, model_key)) AS top_b FROM weight_pairs GROUP BY target_space)
SELECT target_space, top_a, top_b, {r('firm_re_a', 4)} AS firm_re_a, {r('firm_re_b', 4)} AS firm_re_b, top_a <> top_b AS top_cell_changed, (firm_re_a >= 0.5) <> (firm_re_b >= 0.5) AS conclusion_changed,
 CASE WHEN top_a <> top_b OR (firm_re_a >= 0.5) <> (firm_re_b >= 0.5) THEN 'REVISE_PRIMARY_RESULT' WHEN abs(firm_re_a - firm_re_b) >= 0.1 THEN 'QUALIFIES_PRIMARY_RESULT' ELSE 'PASS_PRIMARY_ALIGNMENT' END AS decision FROM s"""))
def _(spark, d):
    return ST.alignment_decision(weight_pairs(spark, d), ["target_space"]).withColumns({c: rnd(c, 4) for c in ("firm_re_a", "firm_re_b")})


@query("stk15_headline_decision", sql_with("families reliability", f"""
WITH m AS (SELECT scheme, target_space, max(CASE WHEN family_rank = 1 THEN family END) AS dominant, sum(CASE WHEN family = 'Jones-family' THEN family_weight END) AS jones FROM families GROUP BY ALL),
s AS (SELECT *, coalesce(jones < 0.5 AND (dominant IN ('Cash-flow/McNichols-family', 'Ball-Shivakumar/asymmetry') OR (target_space = 'real_time' AND dominant = 'No-lookahead/real-time')), false) AS ok FROM m),
w AS (SELECT scheme, bool_or(ok AND target_space = 'ex_post') AS ep, bool_or(ok AND target_space = 'real_time') AS rt, min(jones) AS lo FROM s GROUP BY scheme),
q AS (SELECT scheme, 1 - sum(n_folds_completed) / sum(n_folds_attempted)::DOUBLE AS fs, avg(CASE WHEN reliability_flag IN ('FAILED', 'LOW_RELIABILITY') THEN 1.0 ELSE 0.0 END) AS lo_share FROM reliability GROUP BY scheme)
SELECT scheme, {r('fs')} AS failure_share, {r('lo_share')} AS low_reliability_share, CASE WHEN fs > 0.3 OR lo_share > 0.5 THEN 'INCONCLUSIVE_DUE_TO_KFOLD_FAILURES' WHEN lo >= 0.5 OR (NOT ep AND NOT rt) THEN 'DOES_NOT_SURVIVE' WHEN ep AND rt THEN 'SURVIVES' ELSE 'PARTIALLY_SURVIVES' END AS decision FROM w JOIN q USING (scheme)"""))
def _(spark, d):
    fam = ST.family_rollup(weights(spark, d), G)
    out = ST.headline_decision(fam, ST.reliability(fold_diag(spark, d), K, MK), ["scheme"])
    return out.select("scheme", rnd("failure_share").alias("failure_share"), rnd("low_reliability_share").alias("low_reliability_share"), "decision")


@query("stk16_exclusion_list", sql_with("weights gate", """
SELECT w.scheme, w.target_space, w.model_id, w.variant, coalesce(g.mcmc_status, 'MISSING') AS gate_status, coalesce(g.mcmc_status = 'FAIL', true) AS excluded,
 CASE WHEN g.mcmc_status IS NULL THEN 'gate_status_missing' WHEN g.mcmc_status = 'FAIL' THEN 'gate_status_fail' END AS reason FROM weights w LEFT JOIN gate g USING (target_space, model_id, variant)"""))
def _(spark, d):
    """Every candidate of both schemes against the whole gate table, and whether it is on the exclusion list."""
    g, by = gate(spark, d), ["target_space", "model_id", "variant"]
    cand = weights(spark, d).select("scheme", *by)
    lost = ST.exclusion_list(cand.select(*by).distinct(), g, by, "mcmc_status").select(*by, "reason")
    out = cand.join(g, by, "left").join(lost, by, "left")
    return out.select("scheme", *by, F.coalesce("mcmc_status", F.lit("MISSING")).alias("gate_status"), F.col("reason").isNotNull().alias("excluded"), "reason")


# --- comparisons of weight runs -----------------------------------------------------------------------------

cte("run_weights", "weights", "SELECT 'base' AS run, scheme, target_space, model_key, variant, weight FROM weights UNION ALL SELECT 'variant', scheme, target_space, model_key, variant, weight * weight / sum(weight * weight) OVER (PARTITION BY scheme, target_space) FROM weights")


@query("cmp9_shift_agreement", sql_with("run_weights", f"""
WITH s AS (SELECT run, target_space, sum(CASE WHEN variant = '{FIRM_RE}' AND scheme = 'row' THEN weight ELSE 0 END) - sum(CASE WHEN variant = '{FIRM_RE}' AND scheme = 'grouped' THEN weight ELSE 0 END) AS sh,
 arg_min(model_key, (-weight, model_key)) FILTER (WHERE scheme = 'row') AS tr, arg_min(model_key, (-weight, model_key)) FILTER (WHERE scheme = 'grouped') AS tg FROM run_weights GROUP BY ALL)
SELECT target_space, {r('b.sh', 4)} AS base_shift, {r('v.sh', 4)} AS variant_shift, coalesce(CASE WHEN abs(b.sh) > 1e-9 THEN v.sh / b.sh END, 0) >= 0.7 AS retains_shift, sign(b.sh) = sign(v.sh) AS same_direction, b.tr = v.tr AS same_top_row, b.tg = v.tg AS same_top_grouped
FROM (SELECT * FROM s WHERE run = 'base') b JOIN (SELECT * FROM s WHERE run = 'variant') v USING (target_space)"""))
def _(spark, d):
    from pyspark.sql import Window as W

    w = weights(spark, d)
    sq = F.col("weight") * F.col("weight")
    var = w.withColumn("weight", sq / F.sum(sq).over(W.partitionBy(*G)))
    base, other = (C.shift_comparison(x, ["target_space"]) for x in (w, var))
    out = C.shift_agreement(base, other, ["target_space"])
    return out.select("target_space", rnd("firm_re_shift_base", 4).alias("base_shift"), rnd("firm_re_shift_variant", 4).alias("variant_shift"),
                      "retains_shift", "same_direction", "same_top_row", "same_top_grouped")


@query("cmp11_full_vs_strict_space", sql_with("weights reliability", f"""
WITH j AS (SELECT w.*, CASE WHEN rl.reliability_flag IS NULL THEN 'missing_diagnostics' WHEN rl.reliability_flag = 'LOW_RELIABILITY' THEN 'status_low' WHEN rl.max_rhat > 1.008 THEN 'rhat_above_strict_threshold' WHEN rl.min_ess_tail < 300 THEN 'tail_ess_below_strict_threshold' END AS reason FROM weights w LEFT JOIN reliability rl USING (scheme, target_space, model_id, variant)),
k AS (SELECT *, weight / sum(weight) OVER p AS fw, CASE WHEN sum(CASE WHEN reason IS NULL THEN weight ELSE 0 END) OVER p > 0 THEN CASE WHEN reason IS NULL THEN weight ELSE 0 END / sum(CASE WHEN reason IS NULL THEN weight ELSE 0 END) OVER p END AS sw FROM j WINDOW p AS (PARTITION BY scheme, target_space)),
s AS (SELECT scheme, target_space, count(*) AS n_full, count_if(reason IS NULL) AS n_strict, sum(CASE WHEN variant = '{FIRM_RE}' THEN fw ELSE 0 END) AS ff, sum(sw * CASE WHEN variant = '{FIRM_RE}' THEN 1.0 ELSE 0 END) AS sf FROM k GROUP BY ALL)
SELECT scheme, target_space, n_full, n_strict, {r('ff', 4)} AS full_firm_re, {r('sf', 4)} AS strict_firm_re, {r('sf - ff', 4)} AS firm_re_shift, {r('CASE WHEN ff > 0 THEN sf / ff END', 4)} AS firm_re_ratio FROM s"""))
def _(spark, d):
    rel = ST.reliability(fold_diag(spark, d), K, MK).select(*MK, "reliability_flag", "max_rhat", "min_ess_tail")
    rules = [
        ("missing_diagnostics", F.col("reliability_flag").isNull()), ("status_low", F.col("reliability_flag") == "LOW_RELIABILITY"),
        ("rhat_above_strict_threshold", F.col("max_rhat") > 1.008), ("tail_ess_below_strict_threshold", F.col("min_ess_tail") < 300),
    ]
    out = C.strict_space_summary(C.strict_space(weights(spark, d).join(rel, MK, "left"), G, rules), G)
    return out.select(*G, "n_full", "n_strict", *cols_df(["full_firm_re", "strict_firm_re", "firm_re_shift", "firm_re_ratio"], 4))
