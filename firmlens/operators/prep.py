"""Winsorizing and standardising, globally per sample or inside folds, with their audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.columns import clamp, finite, missing
from firmlens.operators.ordered import complement_quantiles, quantiles, unpivot

PROFILE_PROBS = [0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99]
PROFILE_NAMES = ["p01", "p05", "p25", "median", "p75", "p95", "p99"]


def cutoffs(df: DataFrame, keys: list[str], cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(keys, variable, n, lo, hi) type-7 cutoffs of the non-missing values."""
    q = quantiles(df, keys, cols, [lo, hi])
    return q.select(*keys, "variable", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def _as_maps(table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per ``keys`` with a variable -> value map per statistic (as many rows as design groups)."""
    return table.groupBy(*keys).agg(
        *[F.map_from_entries(F.collect_list(F.struct("variable", v))).alias(f"_{v}") for v in values]
    )


def _attach(df: DataFrame, maps: DataFrame, keys: list[str]) -> DataFrame:
    # One row per sample, space or fold: a fixed small number by design, never growing with the data.
    return df.join(F.broadcast(maps), keys, "left") if keys else df.crossJoin(F.broadcast(maps))


def apply_cutoffs(df: DataFrame, cuts: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    # One plain column per cut-off: a lookup in a map for every value took most of the time.
    of = lambda c, v: F.max(F.when(F.col("variable") == c, F.col(v))).alias(f"_{v}_{c}")
    flat = cuts.groupBy(*keys).agg(*[of(c, v) for c in cols for v in ("lo", "hi")])
    joined = _attach(df, flat, keys)
    return joined.withColumns({c: clamp(c, f"_lo_{c}", f"_hi_{c}") for c in cols}).drop(*[f"_{v}_{c}" for c in cols for v in ("lo", "hi")])


def winsorize(df: DataFrame, keys: list[str], cols: list[str], lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    return apply_cutoffs(df, cutoffs(df, keys, cols, lo, hi), keys, cols)


def profile(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """N, mean, sample SD, extremes and percentiles of non-missing values; N = 0 gives NULLs."""
    long = unpivot(df, keys, cols)
    present = F.when(~missing("x"), F.col("x"))
    ks = keys + ["variable"]
    moments = long.groupBy(*ks).agg(
        F.count(present).alias("n_obs"), F.avg(present).alias("mean"), F.stddev_samp(present).alias("sd"),
        F.min(present).alias("min"), F.max(present).alias("max"),
    )
    q = quantiles(df, keys, cols, PROFILE_PROBS)
    named = q.select(*ks, *[F.col("q")[i].alias(n) for i, n in enumerate(PROFILE_NAMES)])
    return moments.join(named, ks, "left")


def cutoff_report(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Cutoffs with the number and share of values strictly outside them."""
    ks = keys + ["variable"]
    cuts = cutoffs(df, keys, cols).drop("n")
    long = unpivot(df, keys, cols).filter(~missing("x")).join(F.broadcast(cuts), ks)
    return long.groupBy(*ks).agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n_obs"),
        F.count_if(F.col("x") < F.col("lo")).alias("n_below"),
        F.count_if(F.col("x") > F.col("hi")).alias("n_above"),
    ).select(
        "*", (F.col("n_below") / F.col("n_obs")).alias("share_below"),
        (F.col("n_above") / F.col("n_obs")).alias("share_above"),
    )


def zscore(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(x - mean) / sample SD per ``keys``; a missing or zero SD gives 0."""
    st = unpivot(df, keys, cols).filter(~missing("x")).groupBy(*keys, "variable").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")
    )
    return apply_zscore(df, st, keys, cols)


def apply_zscore(df: DataFrame, stats: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    joined = _attach(df, _as_maps(stats, keys, ["mean", "sd"]), keys)
    z = lambda c: F.when(F.col("_sd")[c] > 0, (F.col(c) - F.col("_mean")[c]) / F.col("_sd")[c]).otherwise(0.0)
    return joined.withColumns({c: z(c) for c in cols}).drop("_mean", "_sd")


def fold_views(df: DataFrame, k: int, fold: str = "fold_id") -> DataFrame:
    """Every row once per fold with the role it has there: ``train`` or ``test``."""
    each = F.explode(F.sequence(F.lit(1), F.lit(k)))
    return df.withColumn("fold", each).withColumn(
        "part", F.when(F.col("fold") == F.col(fold), "test").otherwise("train")
    )


def complement_cutoffs(df: DataFrame, keys: list[str], cols: list[str], k: int, fold: str = "fold_id", lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """(keys, variable, fold, n, lo, hi): cutoffs of the training part of every fold, without a copy of the rows for each."""
    q = complement_quantiles(df, keys, cols, fold, list(range(1, k + 1)), [lo, hi])
    return q.select(*keys, "variable", "fold", "n", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def clamped_moments(df: DataFrame, keys: list[str], cols: list[str], cuts: DataFrame, fold: str = "fold_id") -> DataFrame:
    """(keys, variable, fold, n_train, mean, sd) of training values clamped to their fold's own cutoffs.

    One scan sums the values of every own fold that lie inside or outside the cutoffs of each other fold; K is a design number, so the sums are K per own fold and
    variable, and the shuffle carries only them.
    """
    ks = [*keys, "variable"]
    long = unpivot(df, [*keys, fold], cols).filter(~missing("x"))
    centre = long.groupBy(*ks).agg(F.avg("x").alias("_c"))
    table = cuts.groupBy(*ks).agg(F.collect_list(F.struct("fold", "lo", "hi")).alias("_cuts"))  # one entry a fold
    wide = long.join(F.broadcast(table.join(centre, ks)), ks)
    each = wide.select(*ks, F.col(fold).alias("_own"), "_c", "x", F.inline("_cuts")).where("NOT (_own <=> fold)")
    d = F.greatest(F.least(F.col("x"), F.col("hi")), F.col("lo")) - F.col("_c")
    agg = each.groupBy(*ks, "fold").agg(F.max("_c").alias("_c"), F.count("*").alias("n_train"), F.sum(d).alias("s"), F.sum(d * d).alias("ss"))
    n = F.col("n_train")
    var = F.when(n > 1, F.greatest((F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1), F.lit(0.0)))
    return agg.select(*ks, "fold", "n_train", (F.col("_c") + F.col("s") / n).alias("mean"), F.sqrt(var).alias("sd"))


def fold_local(df: DataFrame, keys: list[str], cols: list[str], k: int, winsor: bool = True, fold: str = "fold_id", part: str = "both") -> DataFrame:
    """Winsorize then z-score with statistics of the training part of each fold only.

    Statistics come from complements (see :func:`complement_cutoffs`); rows are repeated only in what is returned: once per fold with their part
    there, or each once in its own fold with ``part="test"``.
    """
    if winsor:
        cuts = complement_cutoffs(df, keys, cols, k, fold)
        st = clamped_moments(df, keys, cols, cuts, fold)
    else:
        st = complement_moments(df, keys, cols, fold)
    views = df.withColumns({"fold": F.col(fold), "part": F.lit("test")}) if part == "test" else fold_views(df, k, fold)
    ks = [*keys, "fold"]
    if winsor:
        views = apply_cutoffs(views, cuts, ks, cols)
    return apply_zscore(views, st, ks, cols)


def train_moments(train: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return unpivot(train, keys, cols).filter(~missing("x")).groupBy(*keys, "variable").agg(
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")
    )


def complement_moments(df: DataFrame, keys: list[str], cols: list[str], fold: str = "fold_id") -> DataFrame:
    """Training mean and SD of every fold in one pass: totals minus the fold's own part.

    Values are shifted by the grand mean first, so subtracting sums of squares stays accurate.
    """
    ks = keys + ["variable"]
    long = unpivot(df, keys + [fold], cols).filter(~missing("x"))
    centre = long.groupBy(*ks).agg(F.avg("x").alias("_c"))
    d = F.col("x") - F.col("_c")
    own = long.join(F.broadcast(centre), ks).groupBy(*ks, fold).agg(
        F.max("_c").alias("_c"), F.count("*").alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("ss")
    )
    total = own.groupBy(*ks).agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("ss").alias("tss"))
    n, s, ss = F.col("tn") - F.col("n"), F.col("ts") - F.col("s"), F.col("tss") - F.col("ss")
    var = F.when(n > 1, F.greatest((ss - s * s / n) / (n - 1), F.lit(0.0)))
    return own.join(total, ks).select(
        *ks, F.col(fold).alias("fold"), n.alias("n_train"),
        F.when(n > 0, F.col("_c") + s / n).alias("mean"), F.sqrt(var).alias("sd"),
    )


def leakage_audit(df: DataFrame, keys: list[str], cols: list[str], k: int, fold: str = "fold_id") -> DataFrame:
    """Training cutoffs of each fold against the global cutoffs, with capped shares on both parts."""
    ks = [*keys, "variable", "fold"]
    local = complement_cutoffs(df, keys, cols, k, fold).drop("n")
    glob = cutoffs(df, keys, cols).select(*keys, "variable", F.col("lo").alias("g_lo"), F.col("hi").alias("g_hi"))
    table = local.groupBy(*keys, "variable").agg(F.collect_list(F.struct("fold", "lo", "hi")).alias("_cuts"))  # one entry a fold
    long = unpivot(df, [*keys, fold], cols).filter(~missing("x")).join(F.broadcast(table), [*keys, "variable"])
    # Each value meets the cutoffs of all folds inside the scan; only counts are shuffled.
    each = long.select(*keys, "variable", F.col(fold).alias("_own"), "x", F.inline("_cuts"))
    is_train = ~F.col("_own").eqNullSafe(F.col("fold"))
    lowc, highc = F.col("x") < F.col("lo"), F.col("x") > F.col("hi")
    agg = each.groupBy(*ks).agg(
        F.max("lo").alias("train_lo"), F.max("hi").alias("train_hi"),
        F.count_if(is_train).alias("n_train"), F.count_if(~is_train).alias("n_test"),
        F.count_if(is_train & lowc).alias("train_low"), F.count_if(is_train & highc).alias("train_high"),
        F.count_if(~is_train & lowc).alias("test_low"), F.count_if(~is_train & highc).alias("test_high"),
    )
    return agg.join(F.broadcast(glob), keys + ["variable"]).select(
        *ks, "train_lo", "train_hi", "n_train", "n_test", "train_low", "train_high", "test_low", "test_high",
        (F.col("train_lo") - F.col("g_lo")).alias("delta_lo"), (F.col("train_hi") - F.col("g_hi")).alias("delta_hi"),
        F.when(F.col("n_test") > 0, F.col("test_low") / F.col("n_test")).alias("share_test_low"),
        F.when(F.col("n_test") > 0, F.col("test_high") / F.col("n_test")).alias("share_test_high"),
    )


def before_after(raw: DataFrame, done: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """SD and range before and after winsorizing."""
    ks = keys + ["variable"]

    def spread(df, tag):
        x = F.when(~missing("x"), F.col("x"))
        return unpivot(df, keys, cols).groupBy(*ks).agg(
            F.stddev_samp(x).alias(f"sd_{tag}"), F.min(x).alias(f"min_{tag}"), F.max(x).alias(f"max_{tag}")
        )

    pos = lambda c: F.when(F.col(c) != 0, F.col(c))
    return spread(raw, "before").join(spread(done, "after"), ks).select(
        "*",
        (100 * (1 - F.col("sd_after") / pos("sd_before"))).alias("sd_reduction_pct"),
        (F.abs("max_before") / F.abs(pos("max_after"))).alias("max_reduction_ratio"),
    )


def standardisation_check(z: DataFrame, keys: list[str], pairs: dict[str, str], firm: str = "company") -> DataFrame:
    """Largest gap between stored and recomputed z-scores, and largest absolute firm mean."""
    ref = zscore(z, keys, list(pairs.values()))
    gap = F.greatest(*[F.max(F.abs(F.col(s) - F.col(raw))) for s, raw in pairs.items()]) if len(pairs) > 1 else None
    s0, raw0 = next(iter(pairs.items()))
    gap = gap if gap is not None else F.max(F.abs(F.col(s0) - F.col(raw0)))
    gaps = ref.groupBy(*keys).agg(gap.alias("max_abs_difference"))
    means = z.groupBy(*keys, firm).agg(*[F.avg(s).alias(s) for s in pairs])
    worst = means.groupBy(*keys).agg(
        *[F.max(F.abs(F.col(s))).alias(f"max_abs_firm_mean_{i}") for i, s in enumerate(pairs)]
    )
    return gaps.join(worst, keys) if keys else gaps.crossJoin(worst)


def denominator_variants(df: DataFrame, keys: list[str], den: str) -> DataFrame:
    """Six alternative denominators: as is, two clamps, two floors, and the group median."""
    q = quantiles(df, keys, [den], [0.01, 0.05, 0.5, 0.95, 0.99]).drop("variable", "n")
    j = df.join(F.broadcast(q), keys) if keys else df.crossJoin(F.broadcast(q))
    x, v = F.col(den), F.col("q")
    return j.select(
        *df.columns,
        x.alias("den_original"),
        clamp(x, v[0], v[4]).alias("den_winsor_1_99"),
        clamp(x, v[1], v[3]).alias("den_winsor_5_95"),
        F.when(finite(x), F.greatest(x, v[0])).alias("den_floor_p01"),
        F.when(finite(x), F.greatest(x, v[1])).alias("den_floor_p05"),
        v[2].alias("den_median"),
    )
