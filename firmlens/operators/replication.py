"""Summaries of replication result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions.columns import finite
from firmlens.operators.aggregates import slope
from firmlens.operators.infer import monotonicity_rate
from firmlens.operators.ordered import quantiles_long


def premium(results: DataFrame, cell: list[str], rep: str = "replication", scheme: str = "validation_target", a: str = "row", b: str = "grouped") -> DataFrame:
    """(firm-intercept minus pooled) score under scheme a, the same under b, and their difference per replication."""
    gain = F.col("score_firmre") - F.col("score_pooled")
    side = lambda s: F.max(F.when(F.col(scheme) == s, gain))
    out = results.groupBy(*cell, rep).agg(side(a).alias("premium_a"), side(b).alias("premium_b"))
    return out.withColumn("premium", F.col("premium_a") - F.col("premium_b"))


def premium_summary(df: DataFrame, cell: list[str], x: str = "premium") -> DataFrame:
    use = df.filter(finite(x))
    m = use.groupBy(*cell).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.avg((F.col(x) > 0).cast("double")).alias("share_positive"))
    q = quantiles_long(use, cell, [0.05, 0.5, 0.95], value=x).select(*cell, *[F.col("q")[i].alias(n) for i, n in enumerate(["p05", "median", "p95"])])
    return m.join(q, cell)


def trend(cells: DataFrame, factor: str, by: list[str], value: str = "mean", material: float = 0.05, mixed: float = 0.02) -> DataFrame:
    """Slope of a cell summary on a design factor with a direction decision."""
    s = slope(cells, by, factor, value).drop("direction")
    return s.withColumn("decision", F.when(F.col("slope").isNull(), "insufficient_variation").when(F.abs("slope") > material, "material_trend")
                        .when(F.abs("slope") <= mixed, "no_trend").otherwise("mixed"))


def pilot_decision(cells: DataFrame, t: str, sigma: str, value: str, prob: str, tol: float = 0.02) -> DataFrame:
    """Monotone rates along both factors and the corner contrast decide whether to run the full grid."""
    rt = monotonicity_rate(cells, [sigma], [], t, value, tol).select(F.col("monotone_rate").alias("monotone_t_rate"))
    rs = monotonicity_rate(cells, [t], [], sigma, value, tol).select(F.col("monotone_rate").alias("monotone_sigma_rate"))
    corner = cells.agg(F.max_by(value, F.struct(t, sigma)).alias("_x"), F.max(t).alias("tmax"), F.max(sigma).alias("smax"), F.min(t).alias("tmin"), F.min(sigma).alias("smin")).drop("_x")
    j = cells.crossJoin(corner)  # one row
    hi, lo = (F.col(t) == F.col("tmax")) & (F.col(sigma) == F.col("smax")), (F.col(t) == F.col("tmin")) & (F.col(sigma) == F.col("smin"))
    c = j.agg((F.max(F.when(hi, F.col(value))) - F.max(F.when(lo, F.col(value)))).alias("high_minus_low"), F.max(F.when(hi, F.col(prob))).alias("high_prob_positive"))
    out = c.crossJoin(rt).crossJoin(rs)
    ok = (F.col("monotone_t_rate") >= 2 / 3) & (F.col("monotone_sigma_rate") >= 2 / 3) & (F.col("high_minus_low") > 0.10) & (F.col("high_prob_positive") >= 0.70)
    return out.withColumn("decision", F.when(ok, "PILOT_PASS__RUN_FULL_GRID").otherwise("PILOT_STOP__DO_NOT_RUN_FULL_SIMULATION"))


def recovery(est: DataFrame, cell: list[str], parameter: str, required: list[str]) -> DataFrame:
    """Estimation error per cell and parameter, and whether the cell has exactly the required parameters."""
    err = F.col("estimate") - F.col("truth")
    per = est.groupBy(*cell, parameter).agg(F.count("*").alias("n"), F.avg(err).alias("mean_error"), F.sqrt(F.avg(err * err)).alias("rmse"), F.max("rhat").alias("max_rhat"))
    have = per.groupBy(*cell).agg(F.sort_array(F.collect_set(parameter)).alias("_p"))  # a handful of parameter names
    want = F.array(*[F.lit(p) for p in sorted(required)])
    return per.join(have.select(*cell, (F.col("_p") == want).alias("parameters_complete")), cell)


def evidence(cells: DataFrame, coverage: DataFrame, sigma: str, t: str, value: str, prob: str, anchor: float = 0.05) -> DataFrame:
    """Per firm-heterogeneity level: mean premium, slope direction in T, anchor check at zero, coverage label."""
    m = cells.groupBy(sigma).agg(F.avg(value).alias("mean_premium"), F.avg(prob).alias("mean_prob_positive"), F.count("*").alias("n_cells"))
    s = slope(cells, [sigma], t, value).select(sigma, "slope", "direction")
    cov = coverage.groupBy(sigma).agg(F.bool_and("complete").alias("coverage_complete"))
    j = m.join(s, sigma).join(cov, sigma, "left")
    label = F.when(~F.coalesce("coverage_complete", F.lit(False)), "incomplete_coverage").when(
        F.col(sigma) == 0, F.when(F.abs("mean_premium") <= anchor, "anchor_ok").otherwise("anchor_violated")).when(F.col("mean_premium") > anchor, "premium_present").otherwise("no_premium")
    return j.withColumn("label", label)
