"""Cross-validated model scores, stacking weights and the specification grid as whole plans."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.functions.columns import normal_log_density
from firmlens.functions.naming import FIRM_RE, POOLED
from firmlens.operators import lsq
from firmlens.operators.cv import history_flags
from firmlens.operators.stacking import model_key
from firmlens.plans.models import FORMULAS, SPACE_MODELS
from firmlens.session import materialise


def cv_scores(folded: DataFrame, models: dict[str, list[str]] = SPACE_MODELS, grid: list[float] = lsq.DEFAULT_GRID, refine: bool = True) -> DataFrame:
    """Held-out scores of every (space, model, variant), from one pass of sufficient statistics: one row per firm-year and model.

    ``folded`` carries ``target_space, company, year, industry, fold_id`` and the panel variables. All models
    of all spaces and folds share one superset design, so the data are read once for the matrices and once
    for the scores.
    """
    return long_scores(*cv_predictions(folded, models, grid, refine)).drop("primary_row_target_inclusion")


def cv_predictions(folded: DataFrame, models: dict[str, list[str]] = SPACE_MODELS, grid: list[float] = lsq.DEFAULT_GRID, refine: bool = True) -> tuple[DataFrame, DataFrame]:
    """Held-out predictions with one row per firm-year, and what they stand for.

    The first table holds (target_space, company, year, fold_id, y_actual, history, preds): the predictions of all models of the space as an array,
    and whether the firm has rows in other folds. The second, of the registry's size, names the entries of a space and fold: (model_id, variant, model_key, pred_sd).
    Rows are shuffled once, by firm; matrices of rows and of firms' train-side sums, and the firms' intercepts, need nothing else.
    """
    keys = ["target_space", "fold_id"]
    terms = list(dict.fromkeys(t for ms in models.values() for m in ms for t in FORMULAS[m]))
    design = lsq.Design(["ta_scaled"], terms, lsq.factor_levels(folded, ["industry", "year"]))
    firms = materialise(lsq.packed_firms(design.project(folded, ["target_space", "company", "year", "fold_id"]), ["target_space"], design), "firms")
    folds = sorted(r[0] for r in folded.select("fold_id").distinct().collect())  # the folds of the design
    own = materialise(lsq.packed_products(firms, ["target_space"], design, folds), "products")
    train = lsq.complement_products(own.where("n_train = 0").drop("n_train"), ["target_space"], "fold_id")
    blocks = own.where("n_train > 0")
    fits = []
    for space, ids in models.items():
        here = lambda df: df.filter(F.col("target_space") == space)
        pooled = {m: (design.index(FORMULAS[m], ["industry", "year"]), 0) for m in ids}
        firm = {m: (design.index(FORMULAS[m], ["year"]), 0) for m in ids}
        sd = F.when(F.col("n") > F.col("rank"), F.sqrt(F.col("rss") / (F.col("n") - F.col("rank"))))
        a = lsq.fit(here(train), keys, design, pooled).select(*keys, "spec", F.lit(POOLED).alias("variant"), sd.alias("sigma"), F.lit(None).cast("double").alias("lam"), "beta")
        b = lsq.fit_random_intercept(here(train), here(blocks), keys, design, firm, grid, refine).select(*keys, "spec", F.lit(FIRM_RE).alias("variant"), "sigma", "lam", "beta")
        fits += [a, b]
    table = reduce(DataFrame.unionByName, fits).collect()  # one row per (space, fold, model, variant): the registry's size
    named: dict[tuple, list] = {}
    for f in sorted(table, key=lambda f: (f.variant != POOLED, f.spec)):
        named.setdefault((f.target_space, f.fold_id), []).append(f)
    coded = {k: (np.array([f.beta for f in fs]).T, np.array([np.nan if f.lam is None else f.lam for f in fs])) for k, fs in named.items()}
    spark = folded.sparkSession
    schema = folded.select(*keys).schema.add("_m", T._parse_datatype_string("array<struct<model_id:string,variant:string,pred_sd:double>>"))
    names = spark.createDataFrame([(*k, [(f.spec, f.variant, f.sigma) for f in fs]) for k, fs in named.items()], schema)
    return lsq.packed_predictions(firms, ["target_space"], design, folds, coded), names


def long_scores(wide: DataFrame, names: DataFrame) -> DataFrame:
    """One row per firm-year and model from :func:`cv_predictions`."""
    by = [c for c in names.columns if c != "_m"]
    j = wide.join(F.broadcast(names), by)
    each = j.select("*", F.posexplode("_m").alias("_i", "_f"))
    mean, sd = F.col("preds")[F.col("_i")], F.col("_f.pred_sd")
    err = F.col("y_actual") - F.col("pred_mean")
    carried = [c for c in wide.columns if c not in ("target_space", "company", "year", "fold_id", "y_actual", "history", "preds")]
    base = each.select(
        "target_space", "company", "year", "fold_id", *carried, F.col("_f.model_id").alias("model_id"), F.col("_f.variant").alias("variant"), "y_actual", mean.alias("pred_mean"), sd.alias("pred_sd"),
        F.col("history").alias("primary_row_target_inclusion"))
    return base.select(
        "target_space", "company", "year", "fold_id", *carried, "model_id", "variant", "y_actual", "pred_mean", "pred_sd", normal_log_density("y_actual", "pred_mean", "pred_sd").alias("lpd_obs"),
        F.abs(err).alias("abs_error"), (err * err).alias("squared_error"), model_key().alias("model_key"), "primary_row_target_inclusion")


def with_inclusion(scores: DataFrame, folded: DataFrame) -> DataFrame:
    """``scores`` with the flags of :func:`~firmlens.operators.cv.history_flags`: rows of firms without other folds are no targets of row validation."""
    by = ["target_space", "company", "fold_id"]
    flags = history_flags(folded.select(*by).distinct(), ["target_space"])
    return scores.join(flags.select(*by, "same_firm_history_available", "primary_row_target_inclusion"), by).drop("same_firm_history_available")


# The outcome specifications (controls, fixed effects, error type).
SPECIFICATIONS = {
    "EV_BASELINE_CORE": (["size", "roa_curr", "revenue_growth"], ["industry", "year"], "firm", False),
    "EV_NO_CONTROLS_CORE": ([], ["industry", "year"], "firm", False),
    "EV_PANEL_LENGTH_CORE": (["size", "roa_curr", "revenue_growth", "panel_length", "firm_age"], ["industry", "year"], "firm", False),
    "EV_FIRM_FE_CORE": (["size", "roa_curr", "revenue_growth"], ["company", "year"], "firm", False),
    "EV_WINSORIZED_OUTCOME_CORE": (["size", "roa_curr", "revenue_growth"], ["industry", "year"], "firm", True),
    "EV_TWO_WAY_CLUSTER_CORE": (["size", "roa_curr", "revenue_growth"], ["industry", "year"], "two_way", False),
    "EV_DENOMINATOR_HARMONIZED": (["size", "roa_curr", "revenue_growth"], ["industry", "year"], "firm", False),
}


# Outcomes of the core specifications, and those that scale the same numerators by current and by next-year assets.
CORE_OUTCOMES = ["future_cfo", "future_roa", "future_earnings", "accrual_reversal"]
HARMONISED_OUTCOMES = ["future_earnings", "future_roa", "future_cfo", "future_cfo_lead_assets"]
OUTCOME_SETS = {name: HARMONISED_OUTCOMES if name == "EV_DENOMINATOR_HARMONIZED" else CORE_OUTCOMES for name in SPECIFICATIONS}


def variation(long: DataFrame, keys: list[str], min_rows: int = 30) -> DataFrame:
    """(keys, n_rows, n_years, n_firms, thin): keys with fewer rows than ``min_rows``, one year or one firm are too thin to be fitted."""
    size = long.groupBy(*keys).agg(
        F.count("y").alias("n_rows"), F.count_distinct("year").alias("n_years"), F.count_distinct("company").alias("n_firms"))
    thin = (F.col("n_rows") < min_rows) | (F.col("n_years") < 2) | (F.col("n_firms") < 2)
    return materialise(size.withColumn("thin", thin), "size")


def specification_grid(
    long: DataFrame, keys: list[str], terms: list[str], specs: dict = SPECIFICATIONS, min_rows: int = 30,
    outcome_sets: dict[str, list[str]] | None = None, outcome_col: str = "outcome",
) -> DataFrame:
    """Coefficients of ``terms`` under every specification; ``long`` has one row per (keys, firm-year) with ``y``.

    Per specification the fits of all keys come from the same aggregates. ``outcome_sets`` names the outcomes of a specification, by
    default all. Keys with too little variation are reported as such instead of being fit. ``r2`` and ``adj_r2`` are of the full model, absorbed firms included.
    """
    from firmlens.operators.prep import winsorize

    of = lambda df, name: df.filter(F.col(outcome_col).isin(outcome_sets[name])) if outcome_sets else df
    size = variation(long, keys, min_rows)
    usable = long.join(F.broadcast(size.filter("not thin").select(*keys)), keys)  # one row per design key
    levels = lsq.factor_levels(long, ["industry", "year"])
    out = None
    for name, (controls, fe, errors, winsor) in specs.items():
        data = of(usable, name)
        if winsor:  # cut-offs of all rows with an outcome, before missing controls take rows away
            data = winsorize(data, keys, ["y"])
        data = lsq.complete(data, ["y", *terms, *controls])
        absorb = "company" in fe
        design = lsq.Design(["y"], terms + controls, {f: levels[f] for f in fe if f != "company"})
        if absorb:
            rows = lsq.absorbed_rows(data, keys, design, "company", ["year"])
        else:
            rows = design.project(data, keys + ["company", "year"])
        rows = materialise(rows, "spec")
        xs = design.index(terms + controls, [f for f in fe if f != "company"])
        if absorb:
            xs = xs[1:]  # the intercept is absorbed
        fits = materialise(lsq.fit(lsq.cross_products(rows, keys, design.values), keys, design, {name: (xs, 0)}), "fits")
        if absorb:
            whole = data.groupBy(*keys).agg(F.count_distinct("company").alias("_g"), (F.var_pop("y") * F.count("y")).alias("_t"))
            fits = fits.join(whole, keys).withColumns({"rank": (F.col("rank") + F.col("_g")).cast("int"), "tss": F.col("_t")})
            fits = materialise(fits.drop("_g", "_t"), "fits")
        scored = lsq.residuals(rows, fits, keys, design)
        clusters = [["company"], ["year"]] if errors == "two_way" else [["company"]]
        part = lsq.clustered(fits, scored, keys, design, terms, clusters)
        out = part if out is None else out.unionByName(part)
    named = F.array(*[F.struct(F.lit(s).alias("spec"), F.array(*[F.lit(o) for o in outcome_sets[s]]).alias("of") if outcome_sets else F.lit(None).cast("array<string>").alias("of")) for s in specs])
    thin = size.filter("thin").select("*", F.inline(named)).filter(F.col("of").isNull() | F.array_contains("of", F.col(outcome_col))) if outcome_sets else size.filter("thin").select("*", F.inline(named))
    skipped = thin.select(
        *keys, "spec", F.col("n_rows").alias("n"), F.lit("insufficient_variation").alias("se_status"),
    ).withColumn("term", F.explode(F.array(*[F.lit(t) for t in terms])))
    return out.unionByName(skipped, allowMissingColumns=True)
