"""Least squares, held-out scores, stacking weights and their comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from firmlens.catalog import sweep as S
from firmlens.catalog.common import K, da_joined, da_table, derived, folded, samples, stage, table, winsorized
from firmlens.catalog.compare_queries import METRICS, matched_sql, metric_pairs
from firmlens.catalog.panel_queries import cols_df, cols_sql
from firmlens.catalog.registry import cte, query, r, sql_with
from firmlens.functions.columns import all_present, precision_weight, rnd
from firmlens.functions.naming import FIRM_RE, POOLED, model_family
from firmlens.operators import compare as C
from firmlens.operators import infer, lsq
from firmlens.operators.absorb import absorbed_ols
from firmlens.operators import panel as P
from firmlens.operators import stacking as ST
from firmlens.operators.joins import full_weights
from firmlens.plans import membership, scoring
from firmlens.plans.models import FORMULAS, SPACE_MODELS

# --- outcome regressions ------------------------------------------------------------------------------

OUT = ["future_cfo", "future_earnings", "future_roa"]
TERMS = ["ta_scaled", "size", "roa_curr", "revenue_growth"]
YEARS = [1996, 1997, 1998, 1999, 2000, 2001]
PW = S.width(TERMS, YEARS)

cte("reg_rows", "outcomes", " UNION ALL ".join(
    f"SELECT '{o}' AS outcome, company, year, industry, {', '.join(TERMS)}, current_earnings, sd_cfo, {o} AS y FROM outcomes WHERE {o} IS NOT NULL AND " + " AND ".join(f"{t} IS NOT NULL" for t in TERMS) for o in OUT))


def outcome_rows(spark, d):
    """(outcome, firm-year, regressors, y) for complete cases, one row per outcome."""
    base = P.outcomes(derived(spark, d)).select(
        "company", "year", "industry", "current_earnings", "sd_cfo", *TERMS,
        F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in OUT])))
    return lsq.complete(base, ["y", *TERMS])


def designed(df, terms, factors=("industry", "year")):
    return lsq.Design(["y"], terms, lsq.factor_levels(df, list(factors)))


def outcome_fit(spark, d, terms=TERMS, weight=None):
    df = outcome_rows(spark, d)
    if weight is not None:
        df = df.withColumn("wt", weight).filter("wt is not null")
    design = designed(df, terms)
    rows = design.project(df, ["outcome", "company", "year"], "wt" if weight is not None else None)
    grams = lsq.cross_products(rows, ["outcome"], design.values, "w")
    return design, rows, lsq.fit(grams, ["outcome"], design, {"base": (design.index(terms, ["industry", "year"]), 0)})


def reg_sql(terms, body, where="true", w="1.0", src="reg_rows", keys=("outcome",), industries=True):
    p = S.width(terms, YEARS, industries)
    text, last = S.sweep("gm", list(keys), p, "sw")
    ks = ", ".join(keys)
    return (f"WITH dr AS MATERIALIZED (SELECT {ks}, company, year, {w} AS w, {S.design_list(terms, YEARS, industries)} AS v FROM {src} WHERE {where}), gm AS MATERIALIZED ({S.gram('dr', list(keys), p + 1, 'w')}),\n"
            f"{text}, ft AS MATERIALIZED ({S.fits(last, list(keys), p)})\n" + body.replace("{LAST}", last).replace("{P}", str(p)).replace("{Q}", str(p + 1)))


def coef_union(terms, keys="outcome", extra=""):
    return " UNION ALL ".join(f"SELECT {keys}, '{t}' AS term, {r(f'beta[{i + 2}]')} AS estimate{extra} FROM ft" for i, t in enumerate(terms))


SE_EXTRA = lambda i: f", {r('sqrt(rss / (n - rank) * -g)')} AS std_error"


@query("reg1_fixed_effect_ols", sql_with("reg_rows", reg_sql(TERMS, " UNION ALL ".join(
    f"SELECT outcome, '{t}' AS term, {r(f'beta[{i + 2}]')} AS estimate, {r('sqrt(rss / (n - rank) * -s.g)')} AS std_error, CAST(n AS BIGINT) AS n FROM ft JOIN {{LAST}} s USING (outcome) WHERE s.i = {i + 2} AND s.j = {i + 2}" for i, t in enumerate(TERMS)))))
def _(spark, d):
    design, _, fits = outcome_fit(spark, d)
    return lsq.coefficients(fits, ["outcome"], design, TERMS).select("outcome", "term", *cols_df(["estimate", "std_error"]), "n")


cte("reg_within", "reg_rows", "SELECT outcome, company, year, industry, " + ", ".join(f"{t} - avg({t}) OVER f AS {t}" for t in TERMS) + ", y - avg(y) OVER f AS y, "
    + ", ".join(f"CAST(year = {v} AS INTEGER) - avg(CAST(year = {v} AS INTEGER)) OVER f AS d{v}" for v in YEARS[1:]) + " FROM reg_rows WINDOW f AS (PARTITION BY outcome, company)")


@query("reg2_firm_fixed_effects", sql_with("reg_within", "WITH dr AS MATERIALIZED (SELECT outcome, CAST([" + ", ".join(TERMS + [f"d{v}" for v in YEARS[1:]]) + f", y] AS DOUBLE[]) AS v FROM reg_within), gm AS MATERIALIZED ({S.gram('dr', ['outcome'], 10)}),\n"
       + S.sweep("gm", ["outcome"], 9, "sw")[0] + f", ft AS MATERIALIZED ({S.fits('sw9', ['outcome'], 9)})\n" + " UNION ALL ".join(f"SELECT outcome, '{t}' AS term, {r(f'beta[{i + 1}]')} AS estimate FROM ft" for i, t in enumerate(TERMS))))
def _(spark, d):
    df = outcome_rows(spark, d)
    design = designed(df, TERMS, ["year"])
    rows = lsq.absorbed_rows(df, ["outcome"], design, "company", ["year"])
    fits = lsq.fit(lsq.cross_products(rows, ["outcome"], design.values), ["outcome"], design, {"within": (design.index(TERMS, ["year"])[1:], 0)})
    return lsq.coefficients(fits, ["outcome"], design, TERMS).select("outcome", "term", rnd("estimate").alias("estimate"))


@query("reg3_weighted_ols", sql_with("reg_rows", reg_sql(TERMS, coef_union(TERMS), where="sd_cfo IS NOT NULL", w="1.0 / greatest(sd_cfo * sd_cfo, 0.01::DOUBLE)")))
def _(spark, d):
    design, _, fits = outcome_fit(spark, d, weight=precision_weight("sd_cfo", 0.01))
    return lsq.coefficients(fits, ["outcome"], design, TERMS).select("outcome", "term", rnd("estimate").alias("estimate"))


INTER = ["current_earnings", "ta_scaled", "current_earnings:ta_scaled", "size", "revenue_growth"]


@query("reg4_interaction", sql_with("reg_rows", reg_sql(INTER, coef_union(INTER[:3]))))
def _(spark, d):
    design, _, fits = outcome_fit(spark, d, INTER)
    return lsq.coefficients(fits, ["outcome"], design, INTER[:3]).select("outcome", "term", rnd("estimate").alias("estimate"))


CLUSTER_SQL = reg_sql(TERMS, f""", iv AS (SELECT outcome, i, list(-g ORDER BY j) AS a FROM {{LAST}} WHERE i <= {{P}} AND j <= {{P}} GROUP BY outcome, i),
er AS (SELECT outcome, company, v[1:{{P}}] AS x, v[{{Q}}] - list_dot_product(v[1:{{P}}], beta) AS e FROM dr JOIN ft USING (outcome)),
ps AS (SELECT outcome, company, i, sum(list_dot_product(a, x) * e) AS s FROM er JOIN iv USING (outcome) WHERE i BETWEEN 2 AND {len(TERMS) + 1} GROUP BY ALL),
vv AS (SELECT outcome, i, sum(s * s) AS m, count(*) AS gg FROM ps GROUP BY ALL)
SELECT outcome, CASE i {' '.join(f"WHEN {k + 2} THEN '{t}'" for k, t in enumerate(TERMS))} END AS term, {r('beta[i]')} AS estimate, {r('sqrt(m * gg / (gg - 1.0) * (n - 1) / (n - rank))')} AS std_error,
 {r('beta[i] / sqrt(m * gg / (gg - 1.0) * (n - 1) / (n - rank))', 4)} AS t_value FROM vv JOIN ft USING (outcome)""")


def clustered_table(spark, d, clusters):
    from firmlens.session import materialise

    design, rows, fits = outcome_fit(spark, d)
    fits = materialise(fits, "fits")
    return lsq.clustered(fits, lsq.residuals(rows, fits, ["outcome"], design), ["outcome"], design, TERMS, clusters)


@query("reg5_firm_clustered_errors", sql_with("reg_rows", CLUSTER_SQL))
def _(spark, d):
    out = clustered_table(spark, d, [["company"]])
    return out.select("outcome", "term", *cols_df(["estimate", "std_error"]), rnd("t_value", 4).alias("t_value"))


@query("reg6_two_way_clustered_errors")
def _(spark, d):
    return clustered_table(spark, d, [["company"], ["year"]]).drop("spec")


@query("reg9_fit_statistics", sql_with("reg_rows", reg_sql(TERMS, f""", nf AS (SELECT outcome, count(DISTINCT company) AS n_firms FROM reg_rows GROUP BY outcome)
SELECT outcome, CAST(n AS BIGINT) AS n, n_firms, rank, {r('sqrt(rss / (n - rank))')} AS sigma, {r('1 - rss / (yy - sy * sy / n)')} AS r2, {r('1 - rss / (yy - sy * sy / n) * (n - 1) / (n - rank)')} AS adj_r2 FROM ft JOIN nf USING (outcome)""")))
def _(spark, d):
    design, rows, fits = outcome_fit(spark, d)
    firms = rows.groupBy("outcome").agg(F.count_distinct("company").alias("n_firms"))
    st = lsq.coefficients(fits, ["outcome"], design, TERMS[:1])
    return st.join(firms, "outcome").select("outcome", "n", "n_firms", F.col("rank").cast("long").alias("rank"), *cols_df(["sigma", "r2", "adj_r2"]))


EXPECT = {"future_cfo": "negative", "future_earnings": "positive", "future_roa": "positive"}


@query("reg11_sign_and_effect_size", sql_with("reg_rows", reg_sql(TERMS, f""", st AS (SELECT outcome, stddev_samp(y) AS sd, avg(abs(y)) AS am FROM reg_rows GROUP BY outcome), c AS (SELECT outcome, beta[2] AS b, CASE outcome WHEN 'future_cfo' THEN 'negative' ELSE 'positive' END AS ex, sd, am FROM ft JOIN st USING (outcome))
SELECT outcome, {r('b')} AS coefficient, ex AS expected_sign, CASE WHEN b > 0 THEN 'positive' WHEN b < 0 THEN 'negative' ELSE 'zero' END AS observed_sign, CASE WHEN (b < 0) = (ex = 'negative') THEN 'sign_consistent' ELSE 'sign_reversal_or_wrong_direction' END AS sign_pattern,
 {r('b / sd')} AS effect_size_sd, {r('b / am')} AS effect_size_abs_mean FROM c""")))
def _(spark, d):
    design, _, fits = outcome_fit(spark, d)
    coefs = lsq.coefficients(fits, ["outcome"], design, ["ta_scaled"]).select("outcome", F.col("estimate").alias("coefficient"))
    st = outcome_rows(spark, d).groupBy("outcome").agg(F.stddev_samp("y").alias("outcome_sd"), F.avg(F.abs("y")).alias("outcome_abs_mean"))
    out = infer.sign_review(coefs, EXPECT, st, ["outcome"])
    return out.select("outcome", "expected_sign", "observed_sign", "sign_pattern", *cols_df(["coefficient", "effect_size_sd", "effect_size_abs_mean"]))


MEMBER_OUT = list(dict.fromkeys(scoring.CORE_OUTCOMES + scoring.HARMONISED_OUTCOMES))
FLAGS = ["row_only", "grouped_only", "common"]
CONTROLS = ["size", "roa_curr", "revenue_growth"]
MEMBER_KEYS = ["target_space", "score", "outcome"]

cte("membership_flags", "metric_pairs", f"""WITH {matched_sql('metric_pairs', 'sample, metric')} SELECT sample AS target_space, metric AS score, company, year,
 CAST(fa AND NOT fb AS INTEGER)::DOUBLE AS row_only, CAST(fb AND NOT fa AS INTEGER)::DOUBLE AS grouped_only, CAST(fa AND fb AS INTEGER)::DOUBLE AS common FROM m2""")
cte("member_rows", "membership_flags outcomes", " UNION ALL ".join(
    f"SELECT target_space, score, '{o}' AS outcome, company, year, industry, {', '.join(FLAGS + CONTROLS)}, {o} AS y FROM membership_flags JOIN outcomes USING (company, year) WHERE {o} IS NOT NULL" for o in MEMBER_OUT))


def membership_packed(spark, d):
    """One row per firm: its firm-years with outcomes, controls and the top-share classes of all spaces and scores, a stage table; and the (space, score) of the bits."""
    slots = [(space, m) for space in ("ex_post", "real_time") for m in METRICS]

    def build():
        base = P.tenure(P.outcomes(derived(spark, d))).select("company", "year", "industry", *CONTROLS, "panel_length", "firm_age", *MEMBER_OUT)
        return membership.packed_rows(base, C.packed_membership(metric_pairs(spark, d), ["sample", "metric"], slots, "a", "b"))

    return stage(spark, d, "membership_packed", build), slots


@query("reg10_specification_grid")
def _(spark, d):
    return membership.specification_grid(*membership_packed(spark, d), MEMBER_OUT, FLAGS, MEMBER_KEYS, outcome_sets=scoring.OUTCOME_SETS)


@query("reg1_absorbed_factors", sql_with("reg_within reg_rows", "WITH dr AS MATERIALIZED (SELECT outcome, CAST([" + ", ".join(TERMS + [f"d{v}" for v in YEARS[1:]]) + f", y] AS DOUBLE[]) AS v FROM reg_within), gm AS MATERIALIZED ({S.gram('dr', ['outcome'], 10)}),\n"
       + S.sweep("gm", ["outcome"], 9, "sw")[0] + f", ft AS MATERIALIZED ({S.fits('sw9', ['outcome'], 9)}), nn AS (SELECT outcome, count(*) AS rows_n, count(DISTINCT company) AS firms FROM reg_rows GROUP BY outcome)\n"
       + " UNION ALL ".join(f"SELECT outcome, '{t}' AS term, {r(f'beta[{i + 1}]')} AS estimate, {r('sqrt(rss / (rows_n - rank - firms) * -s.g)')} AS std_error, rows_n AS n, rank + firms AS rank "
                            f"FROM ft JOIN nn USING (outcome) JOIN sw9 s USING (outcome) WHERE s.i = {i + 1} AND s.j = {i + 1}" for i, t in enumerate(TERMS))))
def _(spark, d):
    """Firms and years absorbed together, whatever their number of levels."""
    out = absorbed_ols(outcome_rows(spark, d), ["outcome"], "y", TERMS, ["company", "year"])
    return out.select("outcome", "term", *cols_df(["estimate", "std_error"]), "n", F.col("rank").cast("long").alias("rank"))


_MP = S.width(FLAGS + CONTROLS, YEARS)
_MQ = _MP + 1
_MK = ", ".join(MEMBER_KEYS)
_msweep, _mlast = S.sweep("loo", [*MEMBER_KEYS, "company"], _MP, "ls")
_fsweep, _flast = S.sweep("tot", MEMBER_KEYS, _MP, "fs")
_flag_case = "CASE a.i " + " ".join(f"WHEN {k + 2} THEN '{t}'" for k, t in enumerate(FLAGS)) + " END"


def _flag_estimates(last, keys):
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return (f"SELECT {', '.join('a.' + k for k in keys)}, {_flag_case} AS term, CASE WHEN b.g <> 0 THEN a.g END AS estimate FROM {last} a JOIN {last} b ON {on} AND b.i = a.i AND b.j = a.i "
            f"WHERE a.j = {_MQ} AND a.i BETWEEN 2 AND {len(FLAGS) + 1}")


@query("reg12_leave_one_firm_out", sql_with("member_rows", f"""
WITH fit_keys AS (SELECT {_MK} FROM member_rows WHERE outcome IN ({', '.join(repr(o) for o in scoring.CORE_OUTCOMES)}) GROUP BY ALL HAVING count(*) >= 30 AND count(DISTINCT year) >= 2 AND count(DISTINCT company) >= 2),
dr AS MATERIALIZED (SELECT {_MK}, company, {S.design_list(FLAGS + CONTROLS, YEARS)} AS v FROM member_rows JOIN fit_keys USING ({_MK}) WHERE {' AND '.join(f'{c} IS NOT NULL' for c in CONTROLS)}),
own AS MATERIALIZED ({S.gram('dr', [*MEMBER_KEYS, 'company'], _MQ)}),
tot AS MATERIALIZED (SELECT {_MK}, i, j, sum(g) AS g FROM own GROUP BY ALL),
loo AS MATERIALIZED (SELECT {_MK}, company, i, j, t.g - o.g AS g FROM own o JOIN tot t USING ({_MK}, i, j)),
{_msweep}, {_fsweep},
fl AS (SELECT {_MK}, term, estimate AS fullc FROM ({_flag_estimates(_flast, MEMBER_KEYS)}))
SELECT {_MK}, term, {r('max(fullc)')} AS full_coefficient, {r('min(estimate)')} AS drop_one_min, {r('max(estimate)')} AS drop_one_max, {r('max(abs(estimate - fullc))')} AS max_abs_change, {r('quantile_cont(estimate, 0.5)')} AS drop_one_median,
 count_if(sign(estimate) <> sign(fullc)) AS sign_flip_n, count(estimate) AS firms_dropped_n, count_if(estimate IS NULL) AS not_estimable_n
FROM ({_flag_estimates(_mlast, [*MEMBER_KEYS, 'company'])}) JOIN fl USING ({_MK}, term) GROUP BY {_MK}, term"""))
def _(spark, d):
    """Influence of single firms on the membership coefficients of the baseline, for all spaces, scores and core outcomes."""
    out = membership.leave_one_firm_out(*membership_packed(spark, d), scoring.CORE_OUTCOMES, FLAGS, CONTROLS, MEMBER_KEYS)
    return out.select(*MEMBER_KEYS, "term", *cols_df(["full_coefficient", "drop_one_min", "drop_one_max", "max_abs_change", "drop_one_median"]), "sign_flip_n", "firms_dropped_n", "not_estimable_n")


# --- held-out scores -------------------------------------------------------------------------------------

GRID = [0.0, 0.05, 0.2, 0.5, 1.0, 2.0]
MODELS = SPACE_MODELS
SCORE_COLS = ["target_space", "model_id", "variant", "model_key", "company", "year", "fold_id", "y_actual", "pred_mean", "pred_sd", "lpd_obs", "abs_error", "squared_error", "primary_row_target_inclusion"]
ALL_TERMS = list(dict.fromkeys(t for ms in MODELS.values() for m in ms for t in FORMULAS[m]))
SY = [1997, 1998, 1999, 2000, 2001]
SP = S.width(ALL_TERMS, SY)
SK = ["scheme", "sample", "fold_id"]

cte("sc_rows", "folded_row folded_grouped", " UNION ALL ".join(
    f"SELECT '{s}' AS scheme, sample, company, year, fold_id, {S.design_list(ALL_TERMS, SY, True, 'ta_scaled')} AS v FROM folded_{s}" for s in ("row", "grouped")))
cte("sc_own", "sc_rows", S.gram("sc_rows", SK, SP + 1))
cte("sc_train", "sc_own", "SELECT scheme, sample, fold_id, i, j, sum(g) OVER (PARTITION BY scheme, sample, i, j) - g AS g FROM sc_own")
cte("sc_firm_own", "sc_rows", f"SELECT scheme, sample, company, fold_id, i, sum(v[i]) AS s FROM sc_rows, (SELECT unnest(range(1, {SP + 2})) AS i) GROUP BY ALL")
cte("sc_firm", "sc_firm_own", """SELECT * FROM (SELECT t.scheme, t.sample, t.company, k.fold_id, list(t.s - coalesce(o.s, 0) ORDER BY t.i) AS s FROM (SELECT scheme, sample, company, i, sum(s) AS s FROM sc_firm_own GROUP BY ALL) t
 CROSS JOIN (SELECT unnest(range(1, 6))::INTEGER AS fold_id) k LEFT JOIN sc_firm_own o ON o.scheme = t.scheme AND o.sample = t.sample AND o.company = t.company AND o.i = t.i AND o.fold_id = k.fold_id GROUP BY ALL) WHERE s[1] > 0""")
cte("sc_block", "sc_firm", f"SELECT scheme, sample, fold_id, s[1] AS m, i, j, sum(s[i] * s[j]) AS g FROM sc_firm, (SELECT unnest(range(1, {SP + 2})) AS i), (SELECT unnest(range(1, {SP + 2})) AS j) GROUP BY ALL")
cte("sc_grid", "", "SELECT unnest([" + ", ".join(f"{g}::DOUBLE" for g in GRID) + "]) AS lam")
cte("sc_lam", "sc_train sc_block sc_grid", """SELECT t.scheme, t.sample, t.fold_id, t.lam, t.i, t.j, t.g - coalesce(b.g, 0) AS g FROM (SELECT * FROM sc_train CROSS JOIN sc_grid) t
 LEFT JOIN (SELECT scheme, sample, fold_id, lam, i, j, sum(lam / (1 + lam * m) * g) AS g FROM sc_block CROSS JOIN sc_grid GROUP BY ALL) b USING (scheme, sample, fold_id, lam, i, j)""")


def _mask_rows():
    rows = []
    names = ["1"] + ALL_TERMS
    for sample, ids in MODELS.items():
        for m in ids:
            for variant in ("pooled", "firm_re"):
                mask = [1] + [int(t in FORMULAS[m]) for t in ALL_TERMS] + [int(variant == "pooled")] * 4 + [1] * (len(SY) - 1) + [1]
                rows.append(f"('{sample}', '{m}', '{variant}', [{', '.join(map(str, mask))}])")
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(sample, model_id, variant, mask)"


cte("sc_mask", "", _mask_rows())
cte("sc_gm", "sc_lam sc_mask", """SELECT l.scheme, l.sample, l.fold_id, model_id, variant, lam, i, j, g * mask[i] * mask[j] AS g FROM sc_lam l JOIN sc_mask m ON l.sample = m.sample AND (m.variant = 'firm_re' OR lam = 0)""")
_GK = SK + ["model_id", "variant", "lam"]
_text, _last = S.sweep("sc_gm", _GK, SP, "scs")
cte("sc_fits", "sc_gm", f"WITH {_text} {S.fits(_last, _GK, SP)}")
cte("sc_best", "sc_fits sc_block sc_train", f"""SELECT scheme, sample, fold_id, model_id, variant, arg_max(lam, ll) AS lam, arg_max(beta, ll) AS beta, arg_max(sigma, ll) AS sigma, max(ll) AS ll, max(n) AS n FROM
 (SELECT f.* EXCLUDE (n), t.n, CASE WHEN variant = 'pooled' THEN sqrt(rss / (t.n - rank)) ELSE sqrt(rss / t.n) END AS sigma, -0.5 * (t.n * (ln(2 * pi() * rss / t.n) + 1) + coalesce(ld, 0)) AS ll
  FROM sc_fits f JOIN (SELECT scheme, sample, fold_id, g AS n FROM sc_train WHERE i = 1 AND j = 1) t USING (scheme, sample, fold_id)
  LEFT JOIN (SELECT scheme, sample, fold_id, lam, sum(g / (m * m) * ln(1 + lam * m)) AS ld FROM sc_block CROSS JOIN sc_grid WHERE i = 1 AND j = 1 GROUP BY ALL) l USING (scheme, sample, fold_id, lam)) GROUP BY ALL""")
cte("scores", "sc_rows sc_best sc_firm", f"""SELECT scheme, target_space, model_id, CASE variant WHEN 'pooled' THEN '{POOLED}' ELSE '{FIRM_RE}' END AS variant, model_id || '_' || target_space || '_' || variant AS model_key, company, year, fold_id, y AS y_actual, pred AS pred_mean, sigma AS pred_sd,
  -0.5 * ln(2 * pi()) - ln(sigma) - (y - pred) * (y - pred) / (2 * sigma * sigma) AS lpd_obs, abs(y - pred) AS abs_error, (y - pred) * (y - pred) AS squared_error, primary_row_target_inclusion
 FROM (SELECT r.scheme, r.sample AS target_space, b.model_id, b.variant, r.company, r.year, r.fold_id, v[{SP + 1}] AS y, sigma, r.scheme = 'grouped' OR f.s IS NOT NULL AS primary_row_target_inclusion, list_dot_product(v[1:{SP}], beta) + CASE WHEN b.variant = 'firm_re' AND f.s IS NOT NULL THEN lam / (1 + lam * f.s[1]) * (f.s[{SP + 1}] - list_dot_product(f.s[1:{SP}], beta)) ELSE 0 END AS pred
  FROM sc_rows r JOIN sc_best b ON r.scheme = b.scheme AND r.sample = b.sample AND r.fold_id = b.fold_id LEFT JOIN sc_firm f ON f.scheme = r.scheme AND f.sample = r.sample AND f.company = r.company AND f.fold_id = r.fold_id)""")


def predictions(spark, d):
    """Held-out predictions of both schemes, one row per scheme and firm-year: a stage table, and the names and spreads of its arrays' entries."""
    parts = {}

    def build():
        wide = []
        for s in ("row", "grouped"):
            found, names = scoring.cv_predictions(folded(spark, d, s).withColumnRenamed("sample", "target_space"), MODELS, GRID, refine=False)
            # Only held-out rows of firms with rows in other folds are targets of the row scheme; every row is one of the grouped scheme.
            wide.append(found.select(F.lit(s).alias("scheme"), "*") if s == "row" else found.withColumn("history", F.lit(True)).select(F.lit(s).alias("scheme"), "*"))
            parts[s] = names.select(F.lit(s).alias("scheme"), "*")
        return wide[0].unionByName(wide[1])

    wide = stage(spark, d, "predictions", build)
    return wide, stage(spark, d, "prediction_names", lambda: parts["row"].unionByName(parts["grouped"]))


def scores(spark, d):
    """Held-out scores of both schemes, one row per scheme, firm-year and model."""
    wide, names = predictions(spark, d)
    return scoring.long_scores(wide, names).select("scheme", *SCORE_COLS)


cte("primary_scores", "scores", "SELECT * FROM scores WHERE primary_row_target_inclusion")


def primary_scores(spark, d):
    """Scores of the rows that a scheme aims at: what roll-ups and stacking use."""
    return scores(spark, d).filter("primary_row_target_inclusion")


@query("reg8_held_out_scores", sql_with("scores", f"SELECT scheme, target_space, model_id, variant, company, year, primary_row_target_inclusion, {cols_sql(['pred_mean', 'pred_sd', 'lpd_obs'], 5)} FROM scores"))
def _(spark, d):
    return scores(spark, d).select("scheme", "target_space", "model_id", "variant", "company", "year", "primary_row_target_inclusion", *cols_df(["pred_mean", "pred_sd", "lpd_obs"], 5))


@query("reg7_random_intercept_ml", sql_with("sc_best", f"SELECT sample, fold_id, model_id, {r('lam')} AS lam, {r('sigma')} AS sigma, {r('ll', 4)} AS loglik FROM sc_best WHERE scheme = 'row' AND variant = 'firm_re'"))
def _(spark, d):
    rows0 = folded(spark, d, "row")
    design = lsq.Design(["ta_scaled"], ALL_TERMS, lsq.factor_levels(rows0, ["industry", "year"]))
    rows = design.project(rows0, ["sample", "company", "fold_id"])
    train = lsq.complement_products(lsq.cross_products(rows, ["sample", "fold_id"], design.values), ["sample"], "fold_id")
    blocks = lsq.cross_products(lsq.firm_sums(rows, ["sample"], design), ["sample", "fold_id", "n_train"], design.values)
    out = None
    for space, ids in MODELS.items():
        specs = {m: (design.index(FORMULAS[m], ["year"]), 0) for m in ids}
        part = lsq.fit_random_intercept(train.filter(F.col("sample") == space), blocks.filter(F.col("sample") == space), ["sample", "fold_id"], design, specs, GRID, refine=False)
        out = part if out is None else out.unionByName(part)
    return out.select("sample", "fold_id", F.col("spec").alias("model_id"), *cols_df(["lam", "sigma"]), rnd("loglik", 4).alias("loglik"))
