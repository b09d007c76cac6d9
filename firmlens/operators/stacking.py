"""Predictive-score roll-ups, reliability, stacking weights and weight tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.functions.columns import finite
from firmlens.functions.naming import FIRM_RE, model_family
from firmlens.operators.lsq import batch_groups

MODEL = ["target_space", "model_id", "variant"]


def weighted_rollup(per: DataFrame, keys: list[str], n: str, mean: str | None = None, rms: str | None = None, spread: str | None = None) -> DataFrame:
    """Second stage of a two-stage roll-up: size-weighted means, RMS of RMS, SD over the first stage."""
    w = F.col(n)
    aggs = [F.sum(w).alias("n_obs")]
    if mean:
        aggs.append((F.sum(w * F.col(mean)) / F.sum(w)).alias(mean))
    if rms:
        aggs.append(F.sqrt(F.sum(w * F.col(rms) * F.col(rms)) / F.sum(w)).alias(rms))
    if spread:
        aggs.append(F.stddev_samp(spread).alias(f"sd_{spread}"))
    return per.groupBy(*keys).agg(*aggs)


def fold_scores(obs: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    return obs.groupBy(*keys, "fold_id").agg(
        F.count("*").alias("n_test_obs"), F.count_distinct("company").alias("n_test_firms"),
        F.sum("lpd_obs").alias("elpd_fold"), F.avg("lpd_obs").alias("mean_lpd_obs"),
        F.sqrt(F.avg("squared_error")).alias("rmse"), F.avg("abs_error").alias("mae"),
    )


def model_scores(folds: DataFrame, keys: list[str] = MODEL) -> DataFrame:
    n = F.col("n_test_obs")
    return folds.groupBy(*keys).agg(
        F.sum(n).alias("n_test_obs_total"), F.sum("n_test_firms").alias("n_test_firms_total"),
        F.sum("elpd_fold").alias("elpd_kfold"), (F.sum(n * F.col("mean_lpd_obs")) / F.sum(n)).alias("mean_lpd_obs"),
        F.stddev_samp("elpd_fold").alias("sd_elpd_fold"),
        F.sqrt(F.sum(n * F.col("rmse") * F.col("rmse")) / F.sum(n)).alias("rmse"),
        (F.sum(n * F.col("mae")) / F.sum(n)).alias("mae"),
    )


def reliability(diag: DataFrame, k: int, keys: list[str] = MODEL, partial_run: bool = False) -> DataFrame:
    """Flag per model from its fold diagnostics, and whether it may enter a stack."""
    agg = diag.groupBy(*keys).agg(
        F.count("*").alias("n_folds_attempted"), F.count_if("completed").alias("n_folds_completed"),
        F.max("max_rhat").alias("max_rhat"), F.min("min_ess_bulk").alias("min_ess_bulk"),
        F.min("min_ess_tail").alias("min_ess_tail"), F.sum("divergences").alias("divergences"),
        F.sum("treedepth_warnings").alias("treedepth_warnings"),
    )
    known = F.col("max_rhat").isNotNull() & F.col("min_ess_bulk").isNotNull() & F.col("min_ess_tail").isNotNull()
    level = lambda rhat, ess: known & (F.col("max_rhat") <= rhat) & (F.col("min_ess_bulk") >= ess) & (F.col("min_ess_tail") >= ess)
    flag = F.when(F.col("n_folds_completed") == 0, "FAILED")
    if not partial_run:
        flag = flag.when(F.col("n_folds_completed") < k, "LOW_RELIABILITY")
    flag = (
        flag.when((F.col("divergences") > 0) | (F.col("treedepth_warnings") > 0), "LOW_RELIABILITY")
        .when(level(1.01, 400), "OK").when(level(1.05, 100), "CAUTION").otherwise("LOW_RELIABILITY")
    )
    enough = F.col("n_folds_completed") > 0 if partial_run else F.col("n_folds_completed") == k
    return agg.withColumn("reliability_flag", flag).withColumn(
        "included_in_stack", F.col("reliability_flag").isin("OK", "CAUTION") & enough
    )


def model_key(space: str = "target_space", model: str = "model_id", variant: str = "variant") -> Column:
    return F.concat_ws("_", model, space, F.when(F.col(variant) == FIRM_RE, "firm_re").otherwise("pooled"))


def alignment_report(obs: DataFrame, groups: list[str], ids: list[str], key: str = "model_key") -> DataFrame:
    """Observations scored by every candidate of their group, and how many are not."""
    per = obs.groupBy(*groups, *ids).agg(F.count_distinct(key).alias("m"), F.count("*").alias("c"))
    models = obs.groupBy(*groups).agg(F.count_distinct(key).alias("n_models"))
    j = per.join(models, groups)
    return j.groupBy(*groups, "n_models").agg(
        F.count("*").alias("n_obs"), F.count_if(F.col("m") < F.col("n_models")).alias("n_incomplete"),
        F.count_if(F.col("c") > F.col("m")).alias("n_duplicated"),
    ).withColumn("aligned", (F.col("n_incomplete") == 0) & (F.col("n_duplicated") == 0))


def log_mean_exp(df: DataFrame, keys: list[str], x: str, out: str = "lme") -> DataFrame:
    """log mean exp(x) per group without overflow, as two aggregates instead of a window over the group."""
    top = df.groupBy(*keys).agg(F.max(x).alias("_m"))
    return df.join(top, keys).groupBy(*keys).agg(
        F.max("_m").alias("_m"), F.avg(F.exp(F.col(x) - F.col("_m"))).alias("_e"), F.count("*").alias("n")
    ).select(*keys, "n", (F.col("_m") + F.log("_e")).alias(out))


def log_sum_exp(df: DataFrame, keys: list[str], x: str, out: str = "lse") -> DataFrame:
    return log_mean_exp(df, keys, x, "_l").select(*keys, "n", (F.col("_l") + F.log("n")).alias(out))


def lpd_rows(obs: DataFrame, groups: list[str], ids: list[str], models: list[str], key: str = "model_key", lpd: str = "lpd_obs") -> DataFrame:
    """One row per observation: (groups, lpd), the log densities as an array in the order of ``models``; NaN for a model outside the observation's group."""
    wide = obs.groupBy(*groups, *ids).pivot(key, models).agg(F.first(lpd))
    return wide.select(*groups, F.array(*[F.coalesce(F.col(f"`{k}`"), F.lit(float("nan"))) for k in models]).alias("lpd"))


KKT_TOL = 1e-10  # stacking stops where no model can add more than this to the mean log density
ZERO_WEIGHT = 1e-6  # contract value: weights up to this are dropped
STEP_SIZES = (1.0, 0.7, 0.5, 0.3, 0.15, 0.05)
FULL_STEP_GAP = 1e-4  # below this gap the quadratic step is taken whole: objectives differ by less than their rounding
INSIDE = 1e-4  # share of the present weights that a step keeps, so that the next density is positive


Problems = dict[tuple, tuple[tuple, list[int]]]  # name of a stack -> its group of observations and the places of its models in their arrays


def _scan(rows: DataFrame, groups: list[str], problems: Problems, names: list, size: Callable[[tuple], int], body: Callable[[tuple, np.ndarray, np.ndarray], np.ndarray]) -> dict[tuple, np.ndarray]:
    """Sums over all observations of ``body(name, densities over the row maximum, row maxima)``, vectors of ``size(name)`` numbers, by problem.

    A task sends one such vector of each problem, whatever its number of rows.
    """
    todo: dict[tuple, list[tuple[int, tuple, list[int]]]] = {}
    for at, name in enumerate(names):
        g, idx = problems[name]
        todo.setdefault(g, []).append((at, name, idx))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = [np.zeros(size(name)) for name in names]
        for batch in batches:
            for g, part in batch_groups(batch, groups) if batch.num_rows else ():
                if g not in todo:
                    continue
                lists = part.column("lpd")
                lpd = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
                for at, name, idx in todo[g]:
                    own = lpd[:, idx]
                    top = own.max(axis=1)
                    acc[at] += body(name, np.exp(own - top[:, None]), top)
        for at, total in enumerate(acc):
            n = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at), pa.int32()), pa.array(np.arange(n), pa.int32()), pa.array(total)], ["q", "i", "v"])

    out = {name: np.zeros(size(name)) for name in names}
    for r in rows.select(*groups, "lpd").mapInArrow(run, "q int, i int, v double").groupBy("q", "i").agg(F.sum("v").alias("v")).collect():
        out[names[r.q]][r.i] = r.v
    return out


def objectives(rows: DataFrame, groups: list[str], problems: Problems, vectors: dict[tuple, list[np.ndarray]]) -> dict[tuple, list[float]]:
    """Mean log mixture density of every problem at each of its weight vectors, in one pass."""

    def body(name: tuple, p: np.ndarray, top: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.append((top[:, None] + np.log(p @ np.column_stack(vectors[name]))).sum(axis=0), len(p))

    sums = _scan(rows, groups, problems, list(vectors), lambda name: len(vectors[name]) + 1, body)
    return {name: (v[:-1] / v[-1]).tolist() for name, v in sums.items()}


def _moments(rows: DataFrame, groups: list[str], problems: Problems, weights: dict[tuple, np.ndarray]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Gradient and curvature of the mean log density: means of p_i / d and of their products. k (k + 1) numbers a problem reach the driver."""

    def body(name: tuple, p: np.ndarray, top: np.ndarray) -> np.ndarray:
        share = p / (p @ weights[name])[:, None]
        return np.concatenate([[len(p)], share.sum(axis=0), (share.T @ share).ravel()])

    sums = _scan(rows, groups, problems, list(weights), lambda name: 1 + len(weights[name]) * (len(weights[name]) + 1), body)
    out = {}
    for name, v in sums.items():
        k = len(weights[name])
        hess = v[1 + k:].reshape(k, k) / v[0]
        out[name] = (v[1:1 + k] / v[0], (hess + hess.T) / 2)
    return out


def _quadratic_step(w: np.ndarray, grad: np.ndarray, hess: np.ndarray, free: list[int]) -> np.ndarray:
    """Minimiser over x >= 0 of the local quadratic of -mean log density + sum(x) at ``w``, by active sets: exact, k is tiny."""
    h = hess[np.ix_(free, free)] + 1e-13 * np.trace(hess) / len(free) * np.eye(len(free))
    c = grad[free] - 1.0 + h @ w[free]
    x, active = np.zeros(len(free)), np.zeros(len(free), dtype=bool)
    for _ in range(50 * len(free)):
        slope = c - h @ x
        slope[active] = -np.inf
        if slope.max(initial=-np.inf) <= 1e-13:
            break
        active[int(slope.argmax())] = True
        while True:
            z = np.zeros(len(free))
            z[active] = np.linalg.lstsq(h[np.ix_(active, active)], c[active], rcond=None)[0]
            low = active & (z <= 0)
            if not low.any():
                break
            x = x + min(x[i] / (x[i] - z[i]) if x[i] > z[i] else 0.0 for i in np.flatnonzero(low)) * (z - x)
            active &= x > 1e-15
            x[~active] = 0.0
            if not active.any():
                break
        x = z if not low.any() else x
    out = np.zeros(len(w))
    out[free] = x
    return out


def optimal_weights(rows: DataFrame, groups: list[str], problems: Problems, tol: float = KKT_TOL, max_steps: int = 60) -> dict[tuple, tuple[np.ndarray, float, int]]:
    """(weights, KKT gap, rounds) of every problem: the maximiser of sum log sum_j w_j p_ij on the simplex, by sequential quadratic programming.

    The objective is concave. Each round is one pass over the rows for the moments of the unfinished problems and one for the step size;
    ``max_j mean(p_ij / density) - 1`` bounds what any weights could add to the mean log density and ends the loop. No convergence is an error.
    """
    w = {name: np.full(len(idx), 1.0 / len(idx)) for name, (_, idx) in problems.items()}
    done: dict[tuple, tuple[np.ndarray, float, int]] = {}
    for step in range(max_steps):
        now = _moments(rows, groups, problems, {name: v for name, v in w.items() if name not in done})
        gaps = {name: float(grad.max() - 1.0) for name, (grad, _) in now.items()}
        done |= {name: (w[name], gap, step) for name, gap in gaps.items() if gap < tol}
        if len(done) == len(w):
            return done
        tried = {}
        for name in [n for n in gaps if n not in done]:
            x = _quadratic_step(w[name], *now[name], list(range(len(w[name]))))
            aim = INSIDE * w[name] + (1 - INSIDE) * x / x.sum()
            if gaps[name] < FULL_STEP_GAP:
                w[name] = aim
            else:
                tried[name] = [w[name], *[w[name] + a * (aim - w[name]) for a in STEP_SIZES]]
        for name, values in (objectives(rows, groups, problems, tried) if tried else {}).items():
            best = int(np.argmax(values[1:])) + 1
            if values[best] < values[0] - 1e-13:
                raise RuntimeError(f"stacking weights: no step along the search direction improves the objective of {name}")
            w[name] = tried[name][best]
    raise RuntimeError(f"stacking weights did not converge in {max_steps} rounds: {[n for n in w if n not in done]}")


def stack_arrays(rows: DataFrame, groups: list[str], names: list[str], stacks: dict[tuple, tuple[tuple, dict[str, int]]], key: str = "model_key", tol: float = KKT_TOL) -> DataFrame:
    """Weight table of several stacks over the same observations: ``rows`` hold (groups, lpd), one row per observation.

    ``stacks`` maps the values of ``names`` (the table's leading columns) to a group and the place of each candidate in that group's arrays. An
    array scores one observation by all candidates, so they are aligned by construction. No row is shuffled.
    """
    spark = rows.sparkSession
    problems = {name: (g, [at[m] for m in sorted(at)]) for name, (g, at) in stacks.items()}
    models = {name: sorted(at) for name, (_, at) in stacks.items()}
    elpd = _totals(rows, groups, problems)
    if any(not np.isfinite(v).all() for v in elpd.values()):
        raise ValueError("non-finite log predictive density in stacking")
    counts = _scan(rows, groups, problems, list(problems), lambda name: 1, lambda name, p, top: np.array([float(len(p))]))
    best = {name: min(zip((-v for v in elpd[name]), models[name]))[1] for name in problems}  # the first key on ties, as in singleton_weights
    found = optimal_weights(rows, groups, problems, tol)
    final = {}
    for name, (w, _, _) in found.items():
        w = np.where(w > ZERO_WEIGHT, w, 0.0)
        final[name] = w / w.sum()
    mixed = objectives(rows, groups, problems, {name: [w] for name, w in final.items()})
    out = []
    for name in problems:
        n, ms = counts[name][0], models[name]
        top = ms.index(best[name])
        single = elpd[name][top] / n
        if mixed[name][0] < single - 1e-9:  # singleton guard; a mean over rows
            final[name] = np.eye(len(ms))[top]
        for i, m in enumerate(ms):
            out.append((*name, m, float(final[name][i]), float(elpd[name][i]), best[name], float(max(mixed[name][0], single) * n), found[name][1], found[name][2], found[name][1] < tol))
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, key]]).add("weight", "double").add("singleton_elpd", "double").add("best_singleton", "string")
    schema = schema.add("objective", "double").add("kkt_gap", "double").add("rounds", T.IntegerType()).add("converged", "boolean")
    return ranked_weights(spark.createDataFrame(out, schema), names, key)


def _totals(rows: DataFrame, groups: list[str], problems: Problems) -> dict[tuple, np.ndarray]:
    """Summed log densities of every candidate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, part in batch_groups(batch, groups) if batch.num_rows else ():
                lists = part.column("lpd")
                v = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).sum(axis=0)
                cols = [pa.array([x] * len(v)) for x in g]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], [*groups, "i", "v"])

    schema = T.StructType([rows.schema[g] for g in groups]).add("i", T.IntegerType()).add("v", "double")
    sums = rows.select(*groups, "lpd").mapInArrow(run, schema).groupBy(*groups, "i").agg(F.sum("v").alias("v")).collect()
    by = {(tuple(r[c] for c in groups), r.i): r.v for r in sums}
    return {name: np.array([by[g, i] for i in idx]) for name, (g, idx) in problems.items()}


def stack(obs: DataFrame, groups: list[str], ids: list[str], key: str = "model_key", lpd: str = "lpd_obs", tol: float = KKT_TOL) -> DataFrame:
    """Weight table (groups, model_key, weight, singleton_elpd, best_singleton, objective, kkt_gap, rounds, converged, rank) of long scores.

    Weights are optimal up to ``tol`` (see :func:`optimal_weights`); those of at most ``ZERO_WEIGHT`` are set to zero and the others rescaled.
    """
    from firmlens.session import materialise

    table = obs.groupBy(*groups, key).agg(F.count_if(~finite(lpd)).alias("bad")).collect()  # one row per (group, model): the registry's size
    if any(r.bad for r in table):
        raise ValueError("non-finite log predictive density in stacking")
    report = alignment_report(obs, groups, ids, key).filter("not aligned").limit(1).collect()
    if report:
        raise ValueError(f"candidates do not score the same observations: {report[0].asDict()}")
    models = sorted({r[key] for r in table})
    stacks: dict[tuple, tuple[tuple, dict[str, int]]] = {}
    for r in table:
        g = tuple(r[c] for c in groups)
        stacks.setdefault(g, (g, {}))[1][r[key]] = models.index(r[key])
    return stack_arrays(materialise(lpd_rows(obs, groups, ids, models, key, lpd), "densities"), groups, groups, stacks, key, tol)


def ranked_weights(weights: DataFrame, groups: list[str], key: str = "model_key", out: str = "rank") -> DataFrame:
    """Rank by falling weight, model key on ties. A group holds one row per candidate model."""
    w = W.partitionBy(*groups).orderBy(F.desc("weight"), key)
    return weights.withColumn(out, F.row_number().over(w).cast("long"))


def pseudo_bma(elpd: DataFrame, groups: list[str], x: str = "elpd_kfold") -> DataFrame:
    w = W.partitionBy(*groups)
    e = F.exp(F.col(x) - F.max(x).over(w))
    return elpd.withColumn("weight", e / F.sum(e).over(w))


def singleton_weights(elpd: DataFrame, groups: list[str], key: str = "model_key", x: str = "elpd_kfold") -> DataFrame:
    best = elpd.groupBy(*groups).agg(F.min_by(key, F.struct(-F.col(x), F.col(key))).alias("_best"))
    return elpd.join(best, groups).withColumn("weight", (F.col(key) == F.col("_best")).cast("double")).drop("_best")


def objective_at(obs: DataFrame, weights: DataFrame, groups: list[str], ids: list[str], key: str = "model_key", lpd: str = "lpd_obs") -> DataFrame:
    """sum over observations of log sum_j w_j exp(lpd_ij)."""
    j = obs.join(weights.select(*groups, key, "weight"), groups + [key]).filter("weight > 0")
    x = j.withColumn("_x", F.log("weight") + F.col(lpd))
    per = log_sum_exp(x, groups + ids, "_x", "_l")
    return per.groupBy(*groups).agg(F.count("*").alias("n_obs"), F.sum("_l").alias("objective"))


def weight_sanity(weights: DataFrame, groups: list[str], key: str = "model_key") -> DataFrame:
    top = F.struct(-F.col("weight"), F.col(key))
    agg = weights.groupBy(*groups).agg(
        F.sum("weight").alias("weight_sum"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
        F.min_by(key, top).alias("top_model"), F.max("best_singleton").alias("best_singleton"),
    )
    return agg.select(
        "*", (F.abs(F.col("weight_sum") - 1) <= 1e-5).alias("sums_to_one"), (F.col("min_weight") >= 0).alias("nonnegative"),
        ((F.col("max_weight") > 0.999) & (F.col("top_model") != F.col("best_singleton"))).alias("top_not_best_singleton"),
    )


def family_rollup(weights: DataFrame, groups: list[str]) -> DataFrame:
    fam = weights.withColumn("family", model_family(F.col("model_id"), F.col("model_id")))
    agg = fam.groupBy(*groups, "family").agg(F.sum("weight").alias("family_weight"), F.count("*").alias("n_models"))
    w = W.partitionBy(*groups).orderBy(F.desc("family_weight"), "family")  # a handful of families
    return agg.withColumn("family_rank", F.row_number().over(w).cast("long"))


def renormalise(weights: DataFrame, groups: list[str], include: Column, floor: float = 1e-6) -> DataFrame:
    """Keep included candidates above the floor and rescale them to sum to one."""
    kept = weights.filter(include & (F.col("weight") > floor))
    w = W.partitionBy(*groups)
    return kept.withColumn("renormalised_weight", F.col("weight") / F.sum("weight").over(w))


def exclusion_list(candidates: DataFrame, gate: DataFrame, keys: list[str], status: str = "status") -> DataFrame:
    j = candidates.join(gate.select(*keys, status), keys, "left")
    reason = F.when(F.col(status).isNull(), "gate_status_missing").otherwise(F.concat(F.lit("gate_status_"), F.lower(status)))
    return j.filter(F.col(status).isNull() | (F.col(status) == "FAIL")).select(
        *keys, F.coalesce(status, F.lit("MISSING")).alias("gate_status"), reason.alias("reason")
    )


def primary_gate(weights: DataFrame, diagnostics: DataFrame, keys: list[str], groups: list[str], floor: float = 1e-6) -> DataFrame:
    """Join weights with full-sample status and held-out reliability, decide inclusion, renormalise the rest.

    ``diagnostics`` holds ``mcmc_status`` per key; ``weights`` hold ``reliability_flag``.
    """
    active = weights.filter(finite("weight") & (F.col("weight") > floor))
    j = active.join(diagnostics.select(*keys, "mcmc_status"), keys, "left").fillna("MISSING", ["mcmc_status", "reliability_flag"])
    good = F.col("reliability_flag").isin("OK", "PASS", "CAUTION")
    st = F.col("mcmc_status")
    decision = (
        F.when(st.isin("PASS", "OK") & good, "INCLUDE_PRIMARY")
        .when(st.isin("REVIEW", "CAUTION", "PSIS_REVIEW_REQUIRED") & good, "MCMC_REVIEW_INCLUDED_WITH_EXACT_REFIT_PASS")
        .when(st.isin("FAIL", "LOW_RELIABILITY"), "EXCLUDE_FULL_SAMPLE_MCMC_FAIL")
        .otherwise("EXCLUDE_RELIABILITY_NOT_PRIMARY")
    )
    j = j.withColumn("decision", decision)
    keep = F.when(~F.col("decision").startswith("EXCLUDE"), F.col("weight")).otherwise(0.0)
    total = F.sum(keep).over(W.partitionBy(*groups))  # candidate models of one space
    return j.withColumn("primary_weight", F.when(total > 0, keep / total))


def weight_comparison(weights: DataFrame, a: str, b: str, keys: list[str], side: str = "scheme") -> DataFrame:
    """Full join of two weight runs with difference, rank change and a stability label."""
    from firmlens.operators.joins import full_weights

    pick = lambda s, n: weights.filter(F.col(side) == s).select(*keys, F.col("weight").alias(f"weight_{n}"), F.col("rank").alias(f"rank_{n}"))
    j = full_weights(pick(a, "a"), pick(b, "b"), keys, ("weight_a", "weight_b"))
    d = F.abs(F.col("weight_a") - F.col("weight_b"))
    return j.select(
        "*", (F.col("weight_a") - F.col("weight_b")).alias("weight_difference"), (F.col("rank_a") - F.col("rank_b")).alias("rank_change"),
        F.when(d < 0.10, "stable").when(d < 0.20, "minor_shift").when(d < 0.50, "material_shift").otherwise("reversal").alias("stability_label"),
    )


def variant_shift(comparison: DataFrame, by: list[str]) -> DataFrame:
    """Aggregate firm-intercept weight on both sides, its shift and ratio."""
    re = (F.col("variant") == FIRM_RE).cast("double")
    out = comparison.groupBy(*by).agg(
        F.sum(F.col("weight_a") * re).alias("firm_re_a"), F.sum(F.col("weight_b") * re).alias("firm_re_b"),
        F.sum(F.col("weight_a") * (1 - re)).alias("pooled_a"), F.sum(F.col("weight_b") * (1 - re)).alias("pooled_b"),
    )
    return out.select("*", (F.col("firm_re_a") - F.col("firm_re_b")).alias("firm_re_shift"),
                      F.when(F.col("firm_re_b") > 0, F.col("firm_re_a") / F.col("firm_re_b")).alias("firm_re_ratio"))


def alignment_decision(comparison: DataFrame, by: list[str], material: float = 0.10, key: str = "model_key") -> DataFrame:
    """Whether a second scoring changes the top cell, the majority conclusion, or the weight materially."""
    top = lambda n: F.min_by(key, F.struct(-F.col(f"weight_{n}"), F.col(key))).alias(f"top_{n}")
    tops = comparison.groupBy(*by).agg(top("a"), top("b"))
    j = variant_shift(comparison, by).join(tops, by)
    changed = F.col("top_a") != F.col("top_b")
    crossed = (F.col("firm_re_a") >= 0.5) != (F.col("firm_re_b") >= 0.5)
    return j.select(
        *by, "top_a", "top_b", "firm_re_a", "firm_re_b", changed.alias("top_cell_changed"), crossed.alias("conclusion_changed"),
        F.when(changed | crossed, "REVISE_PRIMARY_RESULT").when(F.abs("firm_re_shift") >= material, "QUALIFIES_PRIMARY_RESULT")
        .otherwise("PASS_PRIMARY_ALIGNMENT").alias("decision"),
    )


def family_shift(weights: DataFrame, a: str, b: str, by: list[str], l1: float = 0.20, biggest: float = 0.10, side: str = "scheme") -> DataFrame:
    """L1 and maximum shift of family weights between two runs and whether the leading family changed."""
    fam = family_rollup(weights, by + [side])
    pv = fam.groupBy(*by, "family").agg(
        F.sum(F.when(F.col(side) == a, F.col("family_weight")).otherwise(0.0)).alias("wa"),
        F.sum(F.when(F.col(side) == b, F.col("family_weight")).otherwise(0.0)).alias("wb"),
    )
    top = lambda c: F.min_by("family", F.struct(-F.col(c), F.col("family")))
    agg = pv.groupBy(*by).agg(F.sum(F.abs(F.col("wa") - F.col("wb"))).alias("shift_l1"), F.max(F.abs(F.col("wa") - F.col("wb"))).alias("shift_max"),
                              top("wa").alias("top_family_a"), top("wb").alias("top_family_b"))
    moved = (F.col("top_family_a") != F.col("top_family_b")) | (F.col("shift_l1") >= l1) | (F.col("shift_max") >= biggest)
    return agg.withColumn("decision", F.when(moved, "ACCOUNTING_FAMILY_SHIFT_REMAINS_WITHOUT_FIRMRE").otherwise("JOINT_SHIFT_DOMINATED_BY_HETEROGENEITY"))


# Families whose dominance counts as survival in each space.
SURVIVING = {
    "ex_post": ["Cash-flow/McNichols-family", "Ball-Shivakumar/asymmetry"],
    "real_time": ["Cash-flow/McNichols-family", "Ball-Shivakumar/asymmetry", "No-lookahead/real-time"],
}


def headline_decision(families: DataFrame, rel: DataFrame, by: list[str], threshold: float = 0.50, max_failed: float = 0.30, max_low: float = 0.50) -> DataFrame:
    """Does the headline survive: dominant family per space, Jones weight, failures and low reliability."""
    dom = families.groupBy(*by, "target_space").agg(
        F.min_by("family", F.struct("family_rank", "family")).alias("dominant"),
        F.sum(F.when(F.col("family") == "Jones-family", F.col("family_weight"))).alias("jones"),
    )
    ok = F.lit(False)
    for space, fams in SURVIVING.items():
        ok = ok | ((F.col("target_space") == space) & F.col("dominant").isin(*fams))
    dom = dom.withColumn("survives", F.coalesce(ok & (F.col("jones") < threshold), F.lit(False)))
    side = lambda s, c: F.max(F.when(F.col("target_space") == s, F.col(c)))
    wide = dom.groupBy(*by).agg(*[side(s, c).alias(f"{c}_{s}") for s in SURVIVING for c in ("survives", "jones", "dominant")])
    q = rel.groupBy(*by).agg(
        (1 - F.sum("n_folds_completed") / F.sum("n_folds_attempted")).alias("failure_share"),
        F.avg(F.col("reliability_flag").isin("FAILED", "LOW_RELIABILITY").cast("double")).alias("low_reliability_share"),
    )
    j = wide.join(q, by)
    ep, rt = F.coalesce("survives_ex_post", F.lit(False)), F.coalesce("survives_real_time", F.lit(False))
    both = F.coalesce((F.col("jones_ex_post") >= threshold) & (F.col("jones_real_time") >= threshold), F.lit(False))
    return j.withColumn(
        "decision",
        F.when((F.col("failure_share") > max_failed) | (F.col("low_reliability_share") > max_low), "INCONCLUSIVE_DUE_TO_KFOLD_FAILURES")
        .when(both | (~ep & ~rt), "DOES_NOT_SURVIVE").when(ep & rt, "SURVIVES").otherwise("PARTIALLY_SURVIVES"),
    )
