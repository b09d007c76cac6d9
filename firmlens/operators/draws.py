"""Summaries of long draw tables: mixtures, predictive measures, importance sampling, convergence.

Draws per observation (S) are fixed by the sampler or the mixture size, so per-observation aggregates are
bounded; everything that spans observations uses the distributed scans.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmlens.functions.columns import finite, normal_log_density, order_hash, student_log_density
from firmlens.operators.arrays import Read, array_quantiles, array_stats
from firmlens.operators.ordered import average_ranks, quantiles_long, rank_rows
from firmlens.session import materialise


def mixture_plan(weights: DataFrame, draw_ids: DataFrame, groups: list[str], size: int, seed: int = 42, key: str = "model_key", floor: float = 1e-6) -> DataFrame:
    """Which draws of which model make up a mixture of ``size`` rows: (groups, key, draw_id, copies).

    Models get their share by largest remainder; a model's draws are taken in hash order, without
    repetition until its draws run out. ``draw_ids`` lists (groups, key, draw_id) once.
    """
    w = W.partitionBy(*groups)  # models of a space; draws of a model: both fixed by the run's settings
    act = weights.filter(F.col("weight") > floor)
    act = act.withColumn("_s", F.col("weight") / F.sum("weight").over(w) * size).withColumn("_b", F.floor("_s"))
    left = F.lit(size) - F.sum("_b").over(w)
    order = F.row_number().over(w.orderBy(F.desc(F.col("_s") - F.col("_b")), key))
    quota = act.select(*groups, key, (F.col("_b") + (order <= left).cast("int")).cast("int").alias("quota")).filter("quota > 0")
    h = order_hash(seed, F.col(key), F.col("draw_id").cast("string"))
    wd = W.partitionBy(*groups, key)
    ranked = draw_ids.withColumn("_r", F.row_number().over(wd.orderBy(h, "draw_id"))).withColumn("_n", F.count("*").over(wd))
    j = ranked.join(quota, groups + [key])
    copies = F.floor(F.col("quota") / F.col("_n")) + (F.col("_r") <= F.col("quota") % F.col("_n")).cast("int")
    return j.select(*groups, key, "draw_id", copies.cast("int").alias("copies")).filter("copies > 0")


def mixture_draws(draws: DataFrame, plan: DataFrame, groups: list[str], key: str = "model_key") -> DataFrame:
    """Draw rows of the mixture; the same selected draws serve every observation."""
    # The plan has at most ``size`` rows per group, whatever the number of observations.
    j = draws.join(F.broadcast(plan), groups + [key, "draw_id"])
    return j.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


Q = [0.01, 0.025, 0.5, 0.975, 0.99]


def predictive_summary(draws: DataFrame, keys: list[str], y: str = "ta_scaled") -> DataFrame:
    """One pass per observation: moments, quantiles and the predictive percentile."""
    q = F.percentile("predict", Q)
    return draws.groupBy(*keys).agg(
        F.first(y).alias(y), F.count("*").alias("n_draws"), F.avg("epred").alias("nda_mean"), F.stddev_samp("epred").alias("nda_sd_epred"),
        F.stddev_samp("predict").alias("nda_sd_predict"), q.alias("_q"), F.avg((F.col("predict") <= F.col(y)).cast("double")).alias("ppd_percentile"),
    ).select("*", *[F.col("_q")[i].alias(n) for i, n in enumerate(["nda_q010", "nda_q025", "nda_q50", "nda_q975", "nda_q990"])]).drop("_q")


def da_measures(summary: DataFrame, y: str = "ta_scaled") -> DataFrame:
    """Raw and scaled measures, tail flags, tail probability and surprises."""
    raw = F.col(y) - F.col("nda_mean")
    z = lambda sd: F.when(F.col(sd) > 0, raw / F.col(sd))
    out = (F.col(y) < F.col("nda_q025")) | (F.col(y) > F.col("nda_q975"))
    out98 = (F.col(y) < F.col("nda_q010")) | (F.col(y) > F.col("nda_q990"))
    p = F.col("ppd_percentile")
    tail = 2 * F.least(p, 1 - p)
    return summary.select(
        "*", raw.alias("da_raw"), z("nda_sd_epred").alias("da_z_estimation"), z("nda_sd_predict").alias("da_z_predictive"),
        F.abs(raw).alias("abs_da_raw"), out.cast("int").alias("da_tail_flag_95"), out98.cast("int").alias("da_tail_flag_98"),
        tail.alias("ppd_tail_prob"), (-F.log(F.greatest(tail, 1 / F.col("n_draws")))).alias("ppd_tail_surprise"),
        (-normal_log_density(y, "nda_mean", "nda_sd_predict")).alias("gaussian_surprise"),
    )


def kde_log_score(draws: DataFrame, keys: list[str], y: str = "ta_scaled", x: str = "predict") -> DataFrame:
    """log of a Gaussian-kernel density of the draws at the observed value, Silverman bandwidth, floored.

    The bandwidth comes from one aggregate and joins back; no draws are gathered.
    """
    use = draws.filter(finite(x))
    q = F.percentile(x, [0.25, 0.75])
    bw = use.groupBy(*keys).agg(F.count("*").alias("n"), F.stddev_samp(x).alias("_sd"), q.alias("_q"))
    sd = F.when(F.col("_sd") > 0, F.col("_sd")).otherwise(1e-4)
    iqr = F.col("_q")[1] - F.col("_q")[0]
    h = 0.9 * F.least(sd, F.when(iqr > 0, iqr).otherwise(sd) / 1.34) * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    bw = bw.select(*keys, "n", F.when(h > 0, h).otherwise(1e-4).alias("h"))
    u = (F.col(y) - F.col(x)) / F.col("h")
    dens = use.join(bw, keys).groupBy(*keys).agg(
        F.max("n").alias("n"), (F.avg(F.exp(-u * u / 2)) / math.sqrt(2 * math.pi) / F.max("h")).alias("dens"))
    all_keys = draws.select(*keys).distinct().join(dens, keys, "left")
    n, d = F.coalesce("n", F.lit(0)), F.col("dens")
    status = F.when(n < 10, "FLOOR_INSUFFICIENT_DRAWS").when(d.isNull() | F.isnan(d), "FLOOR_KDE_NA").when(d <= 0, "FLOOR_KDE_NONPOSITIVE").otherwise("OK_KDE")
    ok = status == "OK_KDE"
    return all_keys.select(*keys, F.log(F.when(ok, F.greatest(d, F.lit(1e-12))).otherwise(1e-12)).alias("log_score"), status.alias("status"))


def moment_mixture(scores: DataFrame, weights: DataFrame, keys: list[str], on: list[str], y: str = "y_actual") -> DataFrame:
    """Mixture mean and SD from component moments; a missing component makes the result missing."""
    j = scores.join(F.broadcast(weights.select(*on, "weight")), on)  # one row per model
    okm, oks = finite("pred_mean"), finite("pred_sd")
    w, m, s = F.col("weight"), F.col("pred_mean"), F.col("pred_sd")
    agg = j.groupBy(*keys).agg(
        F.first(y).alias(y), F.count("*").alias("n_models"), F.count_if(~okm).alias("n_missing_mean"), F.count_if(~oks).alias("n_missing_sd"),
        F.count_if(oks & (s <= 0)).alias("n_nonpositive_sd"), F.sum(w * m).alias("_m"), F.sum(w * (s * s + m * m)).alias("_e2"),
    )
    mean = F.when(F.col("n_missing_mean") == 0, F.col("_m"))
    sd = F.sqrt(F.greatest(F.col("_e2") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    ok = (F.col("n_missing_mean") == 0) & (F.col("n_missing_sd") == 0)
    out = agg.withColumn("mix_mean", mean).withColumn("mix_sd", F.when(ok & (sd > 0), sd)).drop("_m", "_e2")
    raw = F.col(y) - F.col("mix_mean")
    return out.select("*", raw.alias("da_raw"), (raw / F.col("mix_sd")).alias("da_z_mixture_predictive"))


def group_log_lik(ll: DataFrame, keys: list[str], firm: str = "company") -> DataFrame:
    """Joint log-likelihood of a firm per draw: the input of leave-one-firm-out scores."""
    return ll.groupBy(*keys, firm, "draw_id").agg(F.sum("log_lik").alias("log_lik"), F.count("*").alias("n_obs"))


def held_out_lpd(ll: DataFrame, keys: list[str], y: str = "y_actual") -> DataFrame:
    from firmlens.operators.stacking import log_mean_exp

    m = ll.groupBy(*keys).agg(F.first(y).alias(y), F.avg("epred").alias("pred_mean"), F.stddev_samp("predict").alias("pred_sd"))
    err = F.col(y) - F.col("pred_mean")
    return log_mean_exp(ll, keys, "log_lik", "lpd_obs").join(m, keys).select("*", F.abs(err).alias("abs_error"), (err * err).alias("squared_error"))


def importance_loo(ll: DataFrame, keys: list[str]) -> DataFrame:
    """Plain importance-sampling leave-one-out: elpd = -log mean exp(-log_lik)."""
    lo = ll.groupBy(*keys).agg(F.min("log_lik").alias("_a"), F.max("log_lik").alias("_b"))
    x = F.col("log_lik")
    agg = ll.join(lo, keys).groupBy(*keys).agg(
        F.count("*").alias("n_draws"), (F.max("_b") + F.log(F.avg(F.exp(x - F.col("_b"))))).alias("lpd"),
        (F.min("_a") - F.log(F.avg(F.exp(F.col("_a") - x)))).alias("elpd_loo"))
    return agg.withColumn("p_loo", F.col("lpd") - F.col("elpd_loo"))


# --- draws packed by observation ------------------------------------------------------------------------------

def _by_batch(rows: DataFrame, keys: list[str], arrays: list[str], singles: list[str], fields: str, body: Callable[..., dict[str, np.ndarray]]) -> DataFrame:
    """(keys, fields) from ``body(arrays as matrices, singles as vectors)``: every row holds all draws of its observation, so nothing is shuffled."""
    schema = T.StructType([rows.schema[k] for k in keys] + T._parse_datatype_string(fields).fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            lengths = pc.list_value_length(batch.column(arrays[0])).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths):
                part = batch if (lengths == size).all() else batch.take(pa.array(np.flatnonzero(lengths == size)))
                wide = [part.column(a).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, int(size)) for a in arrays]
                with np.errstate(all="ignore"):
                    got = body(*wide, *[part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in singles])
                cols = [pa.array(got[f.name], mask=np.isnan(got[f.name])) if got[f.name].dtype == float else pa.array(got[f.name]) for f in schema.fields[len(keys):]]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], *cols], schema.names)

    return rows.select(*keys, *arrays, *singles).mapInArrow(run, schema)


def packed_summary(rows: DataFrame, keys: list[str], y: str = "ta_scaled") -> DataFrame:
    """:func:`predictive_summary` of rows (keys, y, epred, predict) that hold an observation's draws as arrays."""
    names = ["nda_q010", "nda_q025", "nda_q50", "nda_q975", "nda_q990"]

    def body(e: np.ndarray, x: np.ndarray, obs: np.ndarray) -> dict[str, np.ndarray]:
        n = x.shape[1]
        sd = lambda a: a.std(axis=1, ddof=1) if n > 1 else np.full(len(a), np.nan)
        out = {y: obs, "n_draws": np.full(len(x), n), "nda_mean": e.mean(axis=1), "nda_sd_epred": sd(e), "nda_sd_predict": sd(x), "ppd_percentile": (x <= obs[:, None]).mean(axis=1)}
        return out | dict(zip(names, np.quantile(x, Q, axis=1)))

    fields = f"{y} double, n_draws long, nda_mean double, nda_sd_epred double, nda_sd_predict double, ppd_percentile double, " + ", ".join(f"{n} double" for n in names)
    return _by_batch(rows, keys, ["epred", "predict"], [y], fields, body)


def packed_kde_log_score(rows: DataFrame, keys: list[str], y: str = "ta_scaled", x: str = "predict") -> DataFrame:
    """:func:`kde_log_score` of rows that hold an observation's draws as an array; non-finite draws take no part."""

    def one(v: np.ndarray, obs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = v.shape[1]
        sd = v.std(axis=1, ddof=1) if n > 1 else np.zeros(len(v))
        sd = np.where(sd > 0, sd, 1e-4)
        lo, hi = np.quantile(v, [0.25, 0.75], axis=1)
        h = 0.9 * np.minimum(sd, np.where(hi > lo, hi - lo, sd) / 1.34) * n ** -0.2
        h = np.where(h > 0, h, 1e-4)
        u = (obs[:, None] - v) / h[:, None]
        return np.exp(-u * u / 2).mean(axis=1) / math.sqrt(2 * math.pi) / h, np.full(len(v), n)

    def body(v: np.ndarray, obs: np.ndarray) -> dict[str, np.ndarray]:
        ok = np.isfinite(v)
        whole = ok.all(axis=1)
        dens, n = np.full(len(v), np.nan), ok.sum(axis=1)
        if whole.any():
            dens[whole], _ = one(v[whole], obs[whole])
        for at in np.flatnonzero(~whole & (n > 0)):
            dens[at] = one(v[at][ok[at]][None, :], obs[at:at + 1])[0][0]
        status = np.where(n < 10, "FLOOR_INSUFFICIENT_DRAWS", np.where(np.isnan(dens), "FLOOR_KDE_NA", np.where(dens <= 0, "FLOOR_KDE_NONPOSITIVE", "OK_KDE"))).astype(object)
        return {"log_score": np.log(np.where(status == "OK_KDE", np.maximum(dens, 1e-12), 1e-12)), "status": status}

    return _by_batch(rows, keys, [x], [y], "log_score double, status string", body)


def packed_importance_loo(rows: DataFrame, keys: list[str], x: str = "log_lik") -> DataFrame:
    """:func:`importance_loo` of rows that hold an observation's log-likelihood draws as an array."""

    def body(ll: np.ndarray) -> dict[str, np.ndarray]:
        a, b = ll.min(axis=1), ll.max(axis=1)
        lpd, loo = b + np.log(np.exp(ll - b[:, None]).mean(axis=1)), a - np.log(np.exp(a[:, None] - ll).mean(axis=1))
        return {"n_draws": np.full(len(ll), ll.shape[1]), "lpd": lpd, "elpd_loo": loo, "p_loo": lpd - loo}

    return _by_batch(rows, keys, [x], [], "n_draws long, lpd double, elpd_loo double, p_loo double", body)


def packed_smoothed_loo(rows: DataFrame, keys: list[str], x: str = "log_lik") -> DataFrame:
    """:func:`pareto_smoothed_loo` of rows that hold an observation's log-likelihood draws as an array."""

    def body(ll: np.ndarray) -> dict[str, np.ndarray]:
        out = smooth_many(ll)
        return {"n_draws": np.full(len(ll), ll.shape[1]), "elpd_loo": out[0], "lpd": out[1], "pareto_k": out[2], "p_loo": out[1] - out[0]}

    return _by_batch(rows, keys, [x], [], "n_draws long, elpd_loo double, lpd double, pareto_k double, p_loo double", body)


def packed_new_firm_marginal(rows: DataFrame, keys: list[str], y: str = "y_actual") -> DataFrame:
    """:func:`new_firm_marginal` of rows with the arrays ``eta``, ``sigma``, ``nu``, ``sigma_u`` and ``u`` (uniform values of the firm), one entry per draw and node."""

    def body(eta: np.ndarray, sigma: np.ndarray, nu: np.ndarray, sigma_u: np.ndarray, u: np.ndarray, obs: np.ndarray) -> dict[str, np.ndarray]:
        mu = eta + sigma_u * _normal_quantile(u)
        few = nu[:1] if (nu == nu[:1]).all() else nu  # mostly the same degrees of freedom in every row
        levels, at = np.unique(few, return_inverse=True)
        const = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(v * math.pi) for v in levels])[at].reshape(few.shape)
        z = (obs[:, None] - mu) / sigma
        ll = const - np.log(sigma) - (nu + 1) / 2 * np.log1p(z * z / nu)
        top = ll.max(axis=1)
        return {"n": np.full(len(mu), mu.shape[1]), "lpd_obs": top + np.log(np.exp(ll - top[:, None]).mean(axis=1)), "pred_mean": mu.mean(axis=1), "pred_sd": mu.std(axis=1, ddof=1)}

    return _by_batch(rows, keys, ["eta", "sigma", "nu", "sigma_u", "u"], [y], "n long, lpd_obs double, pred_mean double, pred_sd double", body)


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """:func:`normal_quantile` of numbers."""
    q = p - 0.5
    tail = lambda x: np.polyval(_C, x) / np.polyval(_D + (1.0,), x)
    mid = np.polyval(_A, q * q) * q / np.polyval(_B + (1.0,), q * q)
    low, high = np.sqrt(-2 * np.log(p)), np.sqrt(-2 * np.log(1 - p))
    return np.where(p < 0.02425, tail(low), np.where(p <= 1 - 0.02425, mid, -tail(high)))


# --- Pareto smoothing ----------------------------------------------------------------------------------------

def fit_generalised_pareto(x: np.ndarray) -> tuple[float, float]:
    """Zhang-Stephens posterior-mean fit of a generalised Pareto to sorted positive exceedances, with the
    weak prior on the shape used for importance weights."""
    n = len(x)
    m = 30 + int(np.sqrt(n))
    quart = x[int(n / 4 + 0.5) - 1]
    b = 1.0 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))
    b = b / (3.0 * quart) + 1.0 / x[-1]
    shape = np.log1p(-np.outer(b, x)).mean(axis=1)
    ll = n * (np.log(-b / shape) - shape - 1.0)
    w = np.exp(ll - ll.max())
    w = w / w.sum()
    keep = w >= 10 * np.finfo(float).eps
    w = w[keep] / w[keep].sum()
    bb = (b[keep] * w).sum()
    k = np.log1p(-bb * x).mean()
    sigma = -k / bb
    return (k * n + 0.5 * 10) / (n + 10), sigma


def smooth_weights(log_lik: np.ndarray) -> tuple[float, float, float]:
    """(elpd_loo, lpd, pareto_k) of one observation from its log-likelihood draws."""
    ll = log_lik[np.isfinite(log_lik)]
    s = len(ll)
    lw = -ll - (-ll).max()
    lpd = ll.max() + np.log(np.exp(ll - ll.max()).mean())
    tail = int(np.ceil(min(0.2 * s, 3 * np.sqrt(s))))
    k = np.inf
    if tail >= 5:
        order = np.argsort(lw)
        idx = order[-tail:]
        cut = lw[order[-tail - 1]]
        t = lw[idx]
        if t[-1] - t[0] > np.finfo(float).eps:
            exc = np.exp(t) - np.exp(cut)
            k, sigma = fit_generalised_pareto(exc)
            if np.isfinite(k):
                p = (np.arange(1, tail + 1) - 0.5) / tail
                q = sigma * np.expm1(-k * np.log1p(-p)) / k if abs(k) > 1e-30 else -sigma * np.log1p(-p)
                lw[idx] = np.minimum(np.log(q + np.exp(cut)), 0.0)
    lw = lw - (lw.max() + np.log(np.exp(lw - lw.max()).sum()))
    v = lw + ll
    return float(v.max() + np.log(np.exp(v - v.max()).sum())), float(lpd), float(k)


def smooth_many(log_lik: np.ndarray) -> np.ndarray:
    """(elpd_loo, lpd, pareto_k) of many observations at once, rows of ``log_lik``; the same steps as :func:`smooth_weights`."""
    out = np.full((3, len(log_lik)), np.nan)
    s = log_lik.shape[1]
    tail = int(np.ceil(min(0.2 * s, 3 * np.sqrt(s))))
    fine = np.isfinite(log_lik).all(axis=1) if tail >= 5 else np.zeros(len(log_lik), dtype=bool)
    ll = log_lik[fine]
    lw = -ll - (-ll).max(axis=1, keepdims=True)
    order = np.argsort(lw, axis=1)
    idx = order[:, -tail:]
    cut = np.take_along_axis(lw, order[:, [-tail - 1]], 1)
    t = np.take_along_axis(lw, idx, 1)
    x = np.exp(t) - np.exp(cut)
    m = 30 + int(np.sqrt(tail))
    b = (1.0 - np.sqrt(m / (np.arange(1, m + 1) - 0.5))) / (3.0 * x[:, [int(tail / 4 + 0.5) - 1]]) + 1.0 / x[:, [-1]]
    shape = np.log1p(-b[:, :, None] * x[:, None, :]).mean(axis=2)
    fit = tail * (np.log(-b / shape) - shape - 1.0)
    w = np.exp(fit - fit.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    w = np.where(w >= 10 * np.finfo(float).eps, w, 0.0)
    bb = (b * w).sum(axis=1, keepdims=True) / w.sum(axis=1, keepdims=True)
    raw = np.log1p(-bb * x).mean(axis=1)
    sigma, k = -raw / bb[:, 0], (raw * tail + 0.5 * 10) / (tail + 10)
    p = (np.arange(1, tail + 1) - 0.5) / tail
    q = sigma[:, None] * np.expm1(-k[:, None] * np.log1p(-p)) / k[:, None]
    plain = np.isfinite(k) & (np.abs(k) > 1e-30) & (t[:, -1] - t[:, 0] > np.finfo(float).eps) & np.isfinite(q).all(axis=1)
    np.put_along_axis(lw, idx, np.minimum(np.log(q + np.exp(cut)), 0.0), 1)
    lw = lw - (lw.max(axis=1, keepdims=True) + np.log(np.exp(lw - lw.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)))
    lse = lambda v: v.max(axis=1) + np.log(np.exp(v - v.max(axis=1, keepdims=True)).sum(axis=1))
    out[:, np.flatnonzero(fine)[plain]] = np.stack([lse(lw + ll), lse(ll) - np.log(s), k])[:, plain]
    rest = np.ones(len(log_lik), dtype=bool)
    rest[np.flatnonzero(fine)[plain]] = False
    for at in np.flatnonzero(rest):  # flat tails, few or non-finite draws
        out[:, at] = smooth_weights(log_lik[at])
    return out


_PSIS_TYPE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("elpd_loo", "lpd", "pareto_k")])


@F.pandas_udf(_PSIS_TYPE)
def _psis(arrays: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([smooth_weights(np.asarray(a, dtype=float)) for a in arrays], columns=["elpd_loo", "lpd", "pareto_k"])


def pareto_smoothed_loo(ll: DataFrame, keys: list[str]) -> DataFrame:
    """Pareto-smoothed importance-sampling LOO per observation. The gathered array holds one observation's S draws."""
    arr = ll.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("draw_id", "log_lik"))).alias("_a"))
    out = arr.select(*keys, F.size("_a").alias("n_draws"), _psis(F.transform("_a", lambda s: s["log_lik"])).alias("_p"))
    return out.select(*keys, "n_draws", "_p.*").withColumn("p_loo", F.col("lpd") - F.col("elpd_loo"))


def loo_totals(loo: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count("*")
    return loo.groupBy(*keys).agg(
        n.alias("n_obs"), F.sum("elpd_loo").alias("elpd_loo"), F.sum("p_loo").alias("p_loo"),
        F.sqrt(n * F.var_samp("elpd_loo")).alias("se_elpd_loo"),
    )


def pareto_gate(obs: DataFrame, keys: list[str], k: str = "pareto_k") -> DataFrame:
    x = F.col(k)
    agg = obs.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.max(x).alias("max_pareto_k"), F.count_if(x > 0.7).alias("n_k_gt_0_7"), F.count_if(x > 1.0).alias("n_k_gt_1_0"))
    share = F.col("n_k_gt_0_7") / F.col("n_obs")
    st = F.when(F.col("max_pareto_k").isNull(), "FAIL").when(F.col("n_k_gt_1_0") > 0, "FAIL").when(F.col("n_k_gt_0_7") > 0, "REVIEW").otherwise("PASS")
    return agg.select(
        "*", share.alias("share_k_gt_0_7"), (F.col("n_k_gt_1_0") / F.col("n_obs")).alias("share_k_gt_1_0"), st.alias("psis_status"),
        F.when((F.col("n_k_gt_1_0") > 0) | (share > 0.10), "LOW").when(F.col("n_k_gt_0_7") > 0, "CAUTION").otherwise("OK").alias("reliability"),
    ).withColumn("action", F.when(F.col("psis_status") == "PASS", "use_psis_score").when(F.col("psis_status") == "REVIEW", "exact_refit_sensitivity_required").otherwise("exclude_from_primary_psis_inference"))


# --- convergence ----------------------------------------------------------------------------------------------

# Coefficients of the rational approximation to the inverse normal distribution function.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)


def _poly(coef: tuple, x: Column) -> Column:
    out = F.lit(coef[0])
    for c in coef[1:]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse normal distribution function as a column expression (relative error about 1e-9)."""
    q, low = p - 0.5, F.lit(0.02425)
    r = q * q
    mid = _poly(_A, r) * q / _poly(_B + (1.0,), r)
    ql = F.sqrt(-2 * F.log(p))
    qh = F.sqrt(-2 * F.log(1 - p))
    tail = lambda x: _poly(_C, x) / _poly(_D + (1.0,), x)
    return F.when(p < low, tail(ql)).when(p <= 1 - low, mid).otherwise(-tail(qh))


def split_chains(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Halve every chain by iteration: (keys, half_chain, pos, value)."""
    n = draws.groupBy(*keys, "chain").agg(F.max("iter").alias("_n"))
    j = draws.join(n, keys + ["chain"])
    half = F.floor(F.col("_n") / 2)
    second = (F.col("iter") > half).cast("long")
    return j.select(*keys, (F.col("chain") * 2 + second).alias("half_chain"), (F.col("iter") - second * half).alias("pos"), "value")


def _rhat(split: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    per = split.groupBy(*keys, "half_chain").agg(F.count("*").alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))
    agg = per.groupBy(*keys).agg(F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("bm"))
    return agg.select(*keys, F.when(F.col("w") > 0, F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("bm")) / F.col("w"))).alias(out))


def split_rhat(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Classic split R-hat (two-stage aggregates only)."""
    return _rhat(split_chains(draws, keys), keys, "value", "rhat")


def normal_scores(draws: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    ranked = average_ranks(draws, keys, col, "_rk")
    n = draws.groupBy(*keys).agg(F.count("*").alias("_s"))
    z = normal_quantile((F.col("_rk") - 0.375) / (F.col("_s") + 0.25))
    return ranked.join(n, keys).withColumn(out, z).drop("_rk", "_s")


def rank_rhat(draws: DataFrame, keys: list[str]) -> DataFrame:
    """Rank-normalised split R-hat: the larger of the bulk and the folded version."""
    s = materialise(split_chains(draws, keys), "split")
    med = quantiles_long(s, keys, [0.5], value="value").select(*keys, F.col("q")[0].alias("_med"))
    folded = s.join(F.broadcast(med), keys).select(*keys, "half_chain", "pos", F.abs(F.col("value") - F.col("_med")).alias("value"))
    bulk = _rhat(normal_scores(s, keys, "value", "_z"), keys, "_z", "rhat_bulk")
    fold = _rhat(normal_scores(folded, keys, "value", "_z"), keys, "_z", "rhat_folded")
    return bulk.join(fold, keys).withColumn("rhat", F.greatest("rhat_bulk", "rhat_folded"))


def lag_blocks(series: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, n, b, at, d): the centred values of up to ``block`` consecutive positions and their places in the block."""
    m = series.groupBy(*keys).agg(F.avg("x").alias("_m"), F.count("*").alias("n"))
    c = series.join(m, keys).select(*keys, "n", (F.col("pos") - 1).alias("p"), (F.col("x") - F.col("_m")).alias("d"))
    cut = c.select(*keys, "n", F.floor(F.col("p") / block).alias("b"), (F.col("p") % block).cast("int").alias("at"), "d")
    packed = cut.groupBy(*keys, "n", "b").agg(F.collect_list(F.struct("at", "d")).alias("v"))  # at most ``block`` values
    return packed.select(*keys, "n", "b", F.col("v.at").alias("at"), F.col("v.d").alias("d"))


def lag_products(blocks: DataFrame, keys: list[str], block: int, first: int, last: int) -> DataFrame:
    """(keys, n, lag, s): sums of products d_t d_{t+lag} for first <= lag <= last, from the cross-correlations of pairs of blocks.

    A lag joins blocks whose numbers differ by lag // block or one more. Each such pair is one row of two arrays, correlated by a fast
    Fourier transform, so a task never holds more than pairs of blocks, however long a series or a lag is.
    """
    near, far = first // block, last // block + 1
    left = blocks.select(*keys, "n", F.col("at").alias("ax"), F.col("d").alias("x"), F.explode(F.sequence(F.col("b") + near, F.col("b") + far)).alias("b"), F.col("b").alias("own"))
    right = blocks.select(*keys, "b", F.col("at").alias("ay"), F.col("d").alias("y"))
    pairs = left.join(right, keys + ["b"]).select(*keys, "n", (F.col("b") - F.col("own")).alias("k"), "ax", "x", "ay", "y")
    schema = T.StructType([blocks.schema[k] for k in keys] + [T.StructField("n", T.LongType()), T.StructField("lag", T.LongType()), T.StructField("s", T.DoubleType())])

    def spectrum(at: np.ndarray, values: np.ndarray) -> np.ndarray:
        d = np.zeros(2 * block)
        d[at] = values
        return np.fft.rfft(d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for rec in pdf.to_dict("records"):
                around = np.fft.irfft(np.conj(spectrum(rec["ax"], rec["x"])) * spectrum(rec["ay"], rec["y"]), 2 * block)
                steps = np.arange(0 if rec["k"] == 0 else 1 - block, block)
                lag = rec["k"] * block + steps
                use = (lag >= first) & (lag <= last) & (lag < rec["n"])
                yield pd.DataFrame({**{k: rec[k] for k in keys}, "n": rec["n"], "lag": lag[use], "s": around[steps[use]]})

    return pairs.mapInPandas(run, schema).groupBy(*keys, "n", "lag").agg(F.sum("s").alias("s"))


def autocovariance(series: DataFrame, keys: list[str], max_lag: int, block: int = 4096) -> DataFrame:
    """Sums of products (x_t - m)(x_{t+lag} - m) for lags 0..max_lag per series (keys, pos, x)."""
    return lag_products(materialise(lag_blocks(series, keys, block), "blocks"), keys, block, 0, max_lag)


def positive_sequence(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stop, total) of (keys, t, pair): the first negative pair, null if none yet, and the sum of the running minima before it.

    Only pairs before the first negative one are put in order.
    """
    stop = pairs.groupBy(*keys).agg(F.min(F.when(F.col("pair") < 0, F.col("t"))).alias("stop"))
    before = pairs.join(stop, keys).where(F.col("stop").isNull() | (F.col("t") < F.col("stop")))
    low = before.withColumn("low", F.min("pair").over(W.partitionBy(*keys).orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)))
    return stop.join(low.groupBy(*keys).agg(F.sum("low").alias("total")), keys, "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def effective_sizes(draws: DataFrame, keys: list[str], block: int = 4096) -> DataFrame:
    """Bulk and tail effective sample size per parameter from rank-normalised split chains and from both 5 % tails.

    Autocovariances are summed up to ``block`` lags first; the range of lags doubles for those parameters alone whose pairs of
    autocorrelations have not turned negative. Chains are never held whole and no row grows with a chain. A constant
    series has no effective size (NaN). Lags beyond a shorter chain's length count as zero there.
    """
    s = materialise(split_chains(draws, keys), "split")
    tails = quantiles_long(s, keys, [0.05, 0.95], value="value").select(*keys, F.col("q")[0].alias("_lo"), F.col("q")[1].alias("_hi"))
    j = normal_scores(s, keys, "value", "_z").join(tails, keys)
    long = j.select(*keys, "half_chain", "pos", F.inline(F.array(
        F.struct(F.lit("bulk").alias("kind"), F.col("_z").alias("x")),
        F.struct(F.lit("low").alias("kind"), (F.col("value") <= F.col("_lo")).cast("double").alias("x")),
        F.struct(F.lit("high").alias("kind"), (F.col("value") <= F.col("_hi")).cast("double").alias("x")))))
    ks, one = keys + ["kind", "half_chain"], keys + ["kind"]
    long = materialise(long, "essinput")
    blocks = materialise(lag_blocks(long, ks, block), "blocks")
    per = long.groupBy(*ks).agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.count("*").alias("n"))
    facts = per.groupBy(*one).agg(
        F.count("*").alias("m"), F.avg("n").alias("nbar"), F.sum("n").alias("size"), F.avg("var").alias("inner"), F.coalesce(F.var_samp("mean"), F.lit(0.0)).alias("outer"))
    facts = facts.withColumn("whole", F.col("inner") * (F.col("nbar") - 1) / F.col("nbar") + F.col("outer"))
    facts = materialise(facts.withColumn("limit", F.floor(F.col("nbar") / 2)), "chains")  # pairs of lags within the mean length
    longest = facts.agg(F.max("nbar")).first()[0] or 0
    open_, parts, done, first, last = facts.where("whole > 0"), None, None, 0, 2 * (block // 2) - 1
    while True:
        sums = lag_products(blocks.join(open_.select(*one), one, "left_semi"), ks, block, first, last)
        cov = sums.where("n > 1").groupBy(*one, "lag").agg(F.sum(F.col("s") / (F.col("n") - 1)).alias("c"))
        rho = cov.join(facts, one).select(*one, "lag", F.when(F.col("lag") == 0, 1.0).otherwise(1 - (F.col("inner") - F.col("c") / F.col("m")) / F.col("whole")).alias("rho"), "limit")
        pair = rho.groupBy(*one, F.floor(F.col("lag") / 2).alias("t"), "limit").agg(F.sum("rho").alias("pair"))
        new = materialise(pair.where("t < limit").drop("limit"), "pairs")
        parts = new if parts is None else parts.unionByName(new)
        seen = materialise(positive_sequence(parts.join(open_.select(*one), one, "left_semi"), one), "sequence")
        ended = seen if last + 1 >= longest else seen.where("stop is not null")
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.join(ended.select(*one), one, "left_anti")
        if last + 1 >= longest or open_.isEmpty():
            break
        first, last = last + 1, 2 * last + 1
    tau = F.greatest(-1 + 2 * F.col("total"), 1 / F.log10("size"))
    sizes = facts.join(done.select(*one, "total"), one, "left").withColumn("ess", F.when(F.col("whole") > 0, F.col("size") / tau).otherwise(F.lit(float("nan"))))
    of = lambda *kinds: F.min(F.when(F.col("kind").isin(*kinds), F.when(~F.isnan("ess"), F.col("ess"))))
    lost = lambda *kinds: F.coalesce(F.max((F.col("kind").isin(*kinds) & F.isnan("ess"))), F.lit(True))
    pick = lambda *kinds: F.when(lost(*kinds), F.lit(float("nan"))).otherwise(of(*kinds))
    return sizes.groupBy(*keys).agg(pick("bulk").alias("ess_bulk"), pick("low", "high").alias("ess_tail"))


STRICT_ESS = 1000  # fixed value: the strict marker asks for this many effective draws in bulk and tail


def mcmc_gate(detail: DataFrame, keys: list[str], sampler: DataFrame) -> DataFrame:
    """Gate per model from parameter diagnostics (rhat, ess_bulk, ess_tail) and sampler counts (divergences, treedepth_hits)."""
    agg = detail.groupBy(*keys).agg(
        F.count("*").alias("n_parameters"), F.max("rhat").alias("max_rhat"), F.min("ess_bulk").alias("min_bulk"), F.min("ess_tail").alias("min_tail"),
        F.count_if(F.col("rhat") > 1.01).alias("n_rhat_gt_1_01"), F.count_if(F.col("ess_bulk") < 400).alias("n_bulk_lt_400"), F.count_if(F.col("ess_tail") < 400).alias("n_tail_lt_400"),
        F.count_if(F.col("ess_bulk") < STRICT_ESS).alias("n_bulk_lt_1000"), F.count_if(F.col("ess_tail") < STRICT_ESS).alias("n_tail_lt_1000"))
    j = agg.join(sampler, keys, "left").fillna(0, ["divergences", "treedepth_hits"])
    bad = ~finite("max_rhat") | ~finite("min_bulk") | ~finite("min_tail")
    low = F.least("min_bulk", "min_tail")
    flag = F.when(bad | (F.col("max_rhat") > 1.01) | (F.col("divergences") > 0) | (low < 400), "FAIL").when(low < 1000, "REVIEW").otherwise("PASS")
    say = lambda cond, fmt, *cols: F.when(cond, F.format_string(fmt, *cols))
    reason = F.concat_ws(
        "; ", say(F.col("max_rhat") > 1.01, "Rhat max %.4f > 1.01", "max_rhat"), say(F.col("divergences") > 0, "divergences=%d", "divergences"),
        say(F.col("min_bulk") < 400, "bulk ESS min %.1f < 400", "min_bulk"), say(F.col("min_tail") < 400, "tail ESS min %.1f < 400", "min_tail"))
    share = lambda c: (F.col(c) / F.col("n_parameters")).alias("share_" + c[2:])
    strict = (F.col("min_bulk") >= STRICT_ESS) & (F.col("min_tail") >= STRICT_ESS)
    counts = ("n_rhat_gt_1_01", "n_bulk_lt_400", "n_tail_lt_400", "n_bulk_lt_1000", "n_tail_lt_1000")
    return j.select("*", *[share(c) for c in counts], strict.alias("ess_strict_passed"), flag.alias("status"), reason.alias("reason"))


# --- marginal new-firm density, predictive checks ---------------------------------------------------------------

def new_firm_marginal(eta: DataFrame, keys: list[str], nodes: int, y: str = "y_actual", firm: str = "company", seed: int = 42) -> DataFrame:
    """log mean over draws and new-firm effects of a Student-t density.

    ``eta`` holds (keys, draw_id, eta, sigma, nu, sigma_u). The effect of a draw is sigma_u times a standard
    normal value made from a hash of (firm, draw, node): all rows of a firm share it, as they share the firm.
    """
    from firmlens.operators.stacking import log_mean_exp

    r = eta.withColumn("node", F.explode(F.sequence(F.lit(1), F.lit(nodes))))
    h = order_hash(seed, "newfirm", F.col(firm), F.col("draw_id").cast("string"), F.col("node").cast("string"))
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / float(16 ** 12)
    mu = F.col("eta") + F.col("sigma_u") * normal_quantile(u)
    r = r.withColumn("_mu", mu)
    r = r.withColumn("_ll", student_log_density(y, "_mu", "sigma", "nu"))
    m = r.groupBy(*keys).agg(F.avg("_mu").alias("pred_mean"), F.stddev_samp("_mu").alias("pred_sd"))
    return log_mean_exp(r, keys, "_ll", "lpd_obs").join(m, keys)


MOMENT_Q = [0.01, 0.05, 0.5, 0.95, 0.99]
MOMENTS = ["mean", "sd", "p01", "p05", "median", "p95", "p99"]


def draw_moments(draws: DataFrame, keys: list[str], x: str = "predict") -> DataFrame:
    """Moments of each draw across observations: exact distributed quantiles, keyed by draw."""
    ks = keys + ["draw_id"]
    m = draws.groupBy(*ks).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"))
    q = quantiles_long(draws, ks, MOMENT_Q, value=x)
    return m.join(q.select(*ks, *[F.col("q")[i].alias(n) for i, n in enumerate(MOMENTS[2:])]), ks)


def predictive_check(obs: DataFrame, draws: DataFrame, intervals: DataFrame, keys: list[str], y: str = "ta_scaled") -> DataFrame:
    """Observed against replicated moments, interval coverage, and the flag. ``intervals`` carry the per-row quantiles."""
    o = obs.groupBy(*keys).agg(F.count("*").alias("n_obs"), F.avg(y).alias("o_mean"), F.stddev_samp(y).alias("o_sd"))
    oq = quantiles_long(obs, keys, [0.01, 0.99], value=y).select(*keys, F.col("q")[0].alias("o_p01"), F.col("q")[1].alias("o_p99"))
    r = draw_moments(draws, keys).groupBy(*keys).agg(*[F.avg(c).alias(f"r_{c}") for c in MOMENTS])
    out = lambda a, b: F.avg(((F.col(y) < F.col(a)) | (F.col(y) > F.col(b))).cast("double"))
    cov = intervals.groupBy(*keys).agg(out("nda_q025", "nda_q975").alias("outside_95"), out("nda_q010", "nda_q990").alias("outside_98"))
    j = o.join(oq, keys).join(r, keys).join(cov, keys)
    md, sd = F.abs(F.col("o_mean") - F.col("r_mean")), F.abs(F.col("o_sd") - F.col("r_sd"))
    td = F.greatest(F.abs(F.col("o_p01") - F.col("r_p01")), F.abs(F.col("o_p99") - F.col("r_p99")))
    return j.select(
        *keys, "n_obs", "outside_95", "outside_98", md.alias("mean_difference"), sd.alias("sd_difference"), td.alias("tail_difference"),
        F.when((md > 0.10) | (sd > 0.15) | (td > 0.20), "FAIL").when((md > 0.05) | (sd > 0.08) | (td > 0.10), "REVIEW").otherwise("PASS").alias("ppc_flag"),
    )


def _sorted_quantile(x: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """Type-7 quantile of the first ``n`` entries along the last axis of ``x``, which rise there."""
    at = (n - 1) * p
    lo = np.maximum(np.floor(at).astype(np.intp), 0)
    pick = lambda i: np.take_along_axis(x, i[..., None], axis=-1)[..., 0]
    a = pick(lo)
    return a + (at - lo) * (pick(np.clip(lo + 1, 0, np.maximum(n - 1, 0))) - a)


def array_predictive_check(rows: DataFrame, read: Read, keys: list[str], models: list[tuple], n_draws: int) -> DataFrame:
    """:func:`predictive_check` of matrices: ``read`` gives all draws of every observation, model after model as in ``models``, and last what was observed.

    Every draw is counted, but none becomes a row: moments of a draw, coverage of an observation and exact quantiles come from passes of matrices.
    """
    k, width = len(models), len(models) * n_draws + 1

    def count(m: np.ndarray) -> np.ndarray:
        x = np.sort(m[:, :-1].reshape(len(m), k, n_draws), axis=2)
        y, n = m[:, -1:], (~np.isnan(x)).sum(axis=2)
        out = lambda a, b: ((y < _sorted_quantile(x, n, a)) | (y > _sorted_quantile(x, n, b))).sum(axis=0)
        return np.concatenate([out(0.025, 0.975), out(0.01, 0.99), [len(m)]])

    st = array_stats(rows, read, width, count, 2 * k + 1)
    q = array_quantiles(rows, read, st, [0.01, 0.99])
    n_obs = int(st.counts[-1])
    known = lambda v: None if np.isnan(v) else float(v)
    out = []
    for i, key in enumerate(models) if n_obs else ():
        own = slice(i * n_draws, (i + 1) * n_draws)
        over = lambda v: v[np.isfinite(v)].mean() if np.isfinite(v).any() else np.nan
        md, sd = abs(st.mean[-1] - over(np.where(st.n > 0, st.mean, np.nan)[own])), abs(st.sd[-1] - over(st.sd[own]))
        td = np.fmax(abs(q[-1, 0] - over(q[own, 0])), abs(q[-1, 1] - over(q[own, 1])))
        flag = "FAIL" if md > 0.10 or sd > 0.15 or td > 0.20 else "REVIEW" if md > 0.05 or sd > 0.08 or td > 0.10 else "PASS"
        out.append((*key, n_obs, float(st.counts[i]) / n_obs, float(st.counts[k + i]) / n_obs, known(md), known(sd), known(td), flag))
    fields = "n_obs long, outside_95 double, outside_98 double, mean_difference double, sd_difference double, tail_difference double, ppc_flag string"
    return rows.sparkSession.createDataFrame(out, T._parse_datatype_string(", ".join(f"{c} string" for c in keys) + ", " + fields))


def prior_predictive_gate(simulated: DataFrame, observed: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Prior-predictive plausibility: share of large values and range against the observed range."""
    a = F.abs(x)
    s = simulated.groupBy(*keys).agg(
        *[F.avg((a > t).cast("double")).alias(f"share_gt_{t}") for t in (1, 2, 5)], F.count_if(~finite(x)).alias("n_nonfinite"))
    rng = lambda df, c, n: quantiles_long(df, keys, [0.01, 0.99], value=c).select(*keys, (F.col("q")[1] - F.col("q")[0]).alias(n))
    j = s.join(rng(simulated, x, "prior_range"), keys, "left").join(rng(observed, y, "observed_range"), keys, "left")
    ratio = F.when(F.col("observed_range") > 0, F.col("prior_range") / F.col("observed_range"))
    within = lambda p1, p2, rr: (F.col("share_gt_1") <= p1) & (F.col("share_gt_2") <= p2) & (F.col("range_ratio") <= rr)
    j = j.withColumn("range_ratio", ratio)
    bad = ~finite("range_ratio") | (F.col("n_nonfinite") > 0)
    return j.withColumn("status", F.when(bad, "FAIL").when(within(0.05, 0.01, 3.0), "PASS").when(within(0.15, 0.02, 5.0), "REVIEW").otherwise("FAIL"))


def matrix_integrity(draws: DataFrame, keys: list[str], obs: list[str], cols: list[str]) -> DataFrame:
    """Observations per draw and missing cells per model: every draw must cover the same observations."""
    per = draws.groupBy(*keys, "draw_id").agg(F.count("*").alias("n"), *[F.count_if(~finite(c)).alias(f"bad_{c}") for c in cols])
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_draws"), F.min("n").alias("min_obs"), F.max("n").alias("max_obs"), *[F.sum(f"bad_{c}").alias(f"n_bad_{c}") for c in cols]
    ).withColumn("complete", (F.col("min_obs") == F.col("max_obs")) & (sum((F.col(f"n_bad_{c}") for c in cols), F.lit(0)) == 0))
