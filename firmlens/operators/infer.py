"""Post-processing of estimates: multiple testing, signs, effect sizes, relative magnitudes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions.columns import finite
from firmlens.functions.naming import sign_label
from firmlens.operators.ordered import rank_rows, running


def benjamini_hochberg(df: DataFrame, family: list[str], p: str, ids: list[str], out: str = "q_value") -> DataFrame:
    """BH q-values per family; missing p-values are not counted and get a NULL q.

    Ranks and the running minimum come from distributed scans, so a family may be any size.
    """
    tested = df.filter(finite(p))
    ranked = rank_rows(tested, family, [F.col(p), *[F.col(c) for c in ids]], "_r")
    m = tested.groupBy(*family).agg(F.count("*").alias("n_tests"))
    raw = (ranked.join(m, family) if family else ranked.crossJoin(m)).withColumn("_raw", F.col(p) * F.col("n_tests") / F.col("_r"))
    q = running(raw, family, [F.col("_r")], {"_q": ("min_after", "_raw")}).withColumn(out, F.least(F.lit(1.0), "_q"))
    done = q.drop("_r", "_raw", "_q")
    rest = df.filter(~finite(p)).withColumn(out, F.lit(None).cast("double"))
    return done.unionByName(rest, allowMissingColumns=True)


def sign_review(coefs: DataFrame, expected: dict[str, str], outcome_stats: DataFrame, keys: list[str]) -> DataFrame:
    """Observed against expected sign and effect sizes in outcome SD and mean-absolute units."""
    exp = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])[F.col("outcome")]
    j = coefs.join(outcome_stats, keys).withColumn("expected_sign", exp)
    b = F.col("coefficient")
    ok = F.when(~finite("coefficient") | F.col("expected_sign").isNull(), F.lit(None).cast("boolean")).when(
        F.col("expected_sign") == "negative", b < 0).when(F.col("expected_sign") == "positive", b > 0)
    return j.withColumn("observed_sign", sign_label(b)).withColumn("sign_consistent", ok).select(
        "*",
        F.when(F.col("sign_consistent").isNull(), "not_evaluable").when(F.col("sign_consistent"), "sign_consistent")
        .otherwise("sign_reversal_or_wrong_direction").alias("sign_pattern"),
        F.when(F.col("outcome_sd") > 0, b / F.col("outcome_sd")).alias("effect_size_sd"),
        F.when(F.col("outcome_abs_mean") > 0, b / F.col("outcome_abs_mean")).alias("effect_size_abs_mean"),
    )


def relative_to(df: DataFrame, keys: list[str], label: str, value: str, anchors: list[str]) -> DataFrame:
    """Absolute value as share of the group maximum and as ratio to labelled rows; groups are short by design."""
    w = W.partitionBy(*keys)
    a = F.abs(value)
    pos = lambda c: F.when(c > 0, c)
    out = df.withColumn("share_of_max", a / pos(F.max(a).over(w)))
    for t in anchors:
        out = out.withColumn(f"ratio_to_{t}", a / pos(F.max(F.when(F.col(label) == t, a)).over(w)))
    return out


def anchored(df: DataFrame, keys: list[str], position: str, value: str, at: float) -> DataFrame:
    """Value minus the value at the position nearest to ``at`` (smaller position on ties)."""
    base = df.groupBy(*keys).agg(F.min_by(value, F.struct(F.abs(F.col(position) - at), F.col(position))).alias("anchor_value"))
    return df.join(base, keys).withColumn("relative_value", F.col(value) - F.col("anchor_value"))


def monotonicity_rate(df: DataFrame, keys: list[str], by: list[str], order: str, value: str, tol: float) -> DataFrame:
    """Share of groups whose ordered metric never falls by more than ``tol``. Groups are short series."""
    step = F.col(value) - F.lag(value).over(W.partitionBy(*by, *keys).orderBy(order))
    per = df.select(*by, *keys, step.alias("_d")).groupBy(*by, *keys).agg(F.bool_and(F.coalesce(F.col("_d") >= -tol, F.lit(True))).alias("monotone"))
    return per.groupBy(*by).agg(F.count("*").alias("n_groups"), F.count_if("monotone").alias("n_monotone"), F.avg(F.col("monotone").cast("double")).alias("monotone_rate"))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz iteration)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    if not (math.isfinite(t) and df > 0):
        return float("nan")
    x = df / (df + t * t)
    if x >= 1.0:
        return 1.0
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b
