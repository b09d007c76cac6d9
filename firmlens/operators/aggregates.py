"""Grouped summaries that recur in audits and reports."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.columns import all_present, correlation, finite, missing
from firmlens.operators.ordered import average_ranks, quantiles_long, running, unpivot
from firmlens.session import materialise


def sample_summary(df: DataFrame, keys: list[str], firm: str = "company") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_obs"), F.count_distinct(firm).alias("n_firms"), F.min("year").alias("min_year"),
        F.max("year").alias("max_year"), F.count_distinct("year").alias("n_years"),
    )


def funnel(df: DataFrame, stages: list[tuple[str, Column]], firm: str = "company") -> DataFrame:
    """The same counts after each cumulative filter, in one pass over the rows."""
    keep, tags = F.lit(True), []
    for i, (name, cond) in enumerate(stages, start=1):
        keep = keep & F.coalesce(cond, F.lit(False))
        tags.append(F.when(keep, F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"))))
    long = df.select(firm, "year", F.inline(F.array_compact(F.array(*tags))))
    return long.groupBy("step", "stage").agg(
        F.count("*").alias("n_obs"), F.count_distinct(firm).alias("n_firms"),
        F.min("year").alias("min_year"), F.max("year").alias("max_year"),
    )


def variable_coverage(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    long = unpivot(df, keys, cols)
    return long.groupBy(*keys, "variable").agg(
        F.count_if(~missing("x")).alias("n_present"), F.count("*").alias("n_rows")
    ).select("*", F.round(100 * F.col("n_present") / F.col("n_rows"), 2).alias("pct_present"))


def availability(df: DataFrame, requirements: dict[str, list[str]]) -> DataFrame:
    """Rows on which every required variable of a model is present."""
    counts = df.agg(*[F.count_if(all_present(v)).alias(m) for m, v in requirements.items()])
    return counts.unpivot([], list(requirements), "model_id", "n_available")


def panel_coverage(df: DataFrame, keys: list[str], firm: str = "company") -> DataFrame:
    """Distribution of years per firm; the inner counts take few distinct values, so percentile is cheap."""
    per = df.select(*keys, firm, "year").distinct().groupBy(*keys, firm).agg(F.count("*").alias("n"))
    n = F.col("n")
    return per.groupBy(*keys).agg(
        F.sum("n").alias("n_observations"), F.count("*").alias("n_firms"), F.avg("n").alias("mean_years"),
        F.percentile("n", 0.5).alias("median_years"), F.min("n").alias("min_years"), F.max("n").alias("max_years"),
        *[F.avg((n == i).cast("double")).alias(f"share_{i}_years") for i in (1, 2, 3, 4)],
        F.avg((n >= 5).cast("double")).alias("share_5plus_years"),
        F.count_if(n == 1).alias("singleton_firms"), F.count_if(n >= 2).alias("eligible_firms"),
    )


def cell_coverage(df: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    per = df.groupBy(*keys, *cell).agg(F.count("*").alias("n"))
    n = F.col("n")
    return per.groupBy(*keys).agg(
        F.count("*").alias("n_cells"), F.avg("n").alias("mean_obs"), F.percentile("n", 0.5).alias("median_obs"),
        F.min("n").alias("min_obs"), F.max("n").alias("max_obs"),
        *[F.count_if(c).alias(f"n_{t}") for t, c in (("eq_1", n == 1), ("lt_5", n < 5), ("lt_10", n < 10))],
        *[F.avg(c.cast("double")).alias(f"share_{t}") for t, c in (("eq_1", n == 1), ("lt_5", n < 5), ("lt_10", n < 10))],
    )


def zero_audit(raw: DataFrame, derived: DataFrame, treatments: dict[str, str]) -> DataFrame:
    """Zeros per variable, how the zero rule treated them, and rows lacking the variable afterwards."""
    cols = list(treatments)
    z = unpivot(raw, [], cols).groupBy("variable").agg(
        F.count_if(~missing("x")).alias("n_nonmissing"), F.count_if(F.col("x") == 0).alias("n_zero")
    )
    lost = unpivot(derived, [], cols).groupBy("variable").agg(F.count_if(missing("x")).alias("n_lost_downstream"))
    t = F.create_map(*[F.lit(x) for kv in treatments.items() for x in kv])[F.col("variable")]
    return z.join(lost, "variable").select(
        "variable", "n_nonmissing", "n_zero", "n_lost_downstream", t.alias("treatment"),
        F.when(F.col("n_nonmissing") > 0, F.col("n_zero") / F.col("n_nonmissing")).alias("zero_share"),
        F.when(t == "zero_to_missing", F.col("n_zero")).otherwise(0).cast("long").alias("n_converted"),
        F.when(t == "zero_kept", F.col("n_zero")).otherwise(0).cast("long").alias("n_retained"),
    )


def share_within(df: DataFrame, keys: list[str], member: str, means: list[str]) -> DataFrame:
    """Size, share of the group total, and outcome means per membership class."""
    per = df.groupBy(*keys, member).agg(F.count("*").alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in means])
    tot = per.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return per.join(tot, keys).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


def concentration(df: DataFrame, keys: list[str], firm: str = "company") -> DataFrame:
    """How strongly a set of rows hangs on few firms; the top firm is the first by count, then name."""
    per = df.groupBy(*keys, firm).agg(F.count("*").alias("n"))
    tot = per.groupBy(*keys).agg(F.sum("n").alias("t"))
    share = F.col("n") / F.col("t")
    return per.join(tot, keys).groupBy(*keys).agg(
        F.max("t").alias("n_obs"), F.count("*").alias("n_firms"), F.max("n").alias("max_obs_per_firm"),
        F.max(share).alias("max_firm_share"), F.count_if(share >= 0.05).alias("n_firms_ge_5pct"),
        F.count_if(share >= 0.10).alias("n_firms_ge_10pct"),
        F.min_by(firm, F.struct(-F.col("n"), F.col(firm))).alias("top_firm"),
    )


def dominant_category(df: DataFrame, key: str, cat: str) -> DataFrame:
    """Most frequent category per key, alphabetical on ties; an aggregate, so no group is ever sorted."""
    per = df.groupBy(key, cat).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(
        F.min_by(cat, F.struct(-F.col("n"), F.col(cat))).alias(f"dominant_{cat}"), F.sum("n").alias("n_rows")
    )


def distribution_text(df: DataFrame, keys: list[str], cat: str, out: str, sep: str = ";", eq: str = "=", by_key: bool = False) -> DataFrame:
    """``k=v`` list of category counts per group. Only the counted categories are gathered."""
    per = df.groupBy(*keys, cat).agg(F.count("*").alias("n"))
    order = F.struct(F.col(cat).alias("k"), F.col("n").alias("n")) if by_key else F.struct((-F.col("n")).alias("m"), F.col(cat).alias("k"), F.col("n").alias("n"))
    item = lambda s: F.concat(s["k"].cast("string"), F.lit(eq), s["n"].cast("string"))
    return per.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), item), sep).alias(out))


def distinct_text(df: DataFrame, keys: list[str], col: str, out: str, sep: str = " | ") -> DataFrame:
    per = df.select(*keys, F.col(col).cast("string").alias("_v")).filter("_v is not null").distinct()
    return per.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("_v")), sep).alias(out))


def pearson(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Correlation on jointly finite rows; fewer than three give NULL."""
    ok = finite(a) & finite(b)
    return df.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), correlation(F.when(ok, F.col(a)), F.when(ok, F.col(b))).alias("_r")
    ).select(*keys, "n", F.when(F.col("n") >= 3, F.col("_r")).alias("pearson"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks on the jointly finite rows."""
    # Four branches read the pair below: write the two columns once instead of recomputing their source.
    both = materialise(df.filter(finite(a) & finite(b)).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")), "pairs")
    ranked = average_ranks(average_ranks(both, keys, "_a", "_ra"), keys, "_b", "_rb")
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), correlation("_ra", "_rb").alias("_r")).select(
        *keys, "n", F.when(F.col("n") >= 3, F.col("_r")).alias("spearman")
    )


def correlation_matrix(df: DataFrame, ids: list[str], cols: list[str]) -> DataFrame:
    """Long Pearson and Spearman matrix on listwise-complete rows.

    Ranks of all columns come from one sorted scan over (variable, value) counts; both matrices are
    single aggregates.
    """
    full = df.filter(all_present(cols)).select(*ids, *cols)
    long = unpivot(full, ids, cols)
    ranks = average_ranks(long, ["variable"], "x", "_rank").groupBy(*ids).pivot("variable", cols).agg(F.first("_rank"))
    pairs = list(combinations_with_replacement(cols, 2))

    def matrix(frame, out):
        wide = frame.agg(*[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs])
        rows = F.array(*[
            F.struct(F.lit(x).alias("variable_1"), F.lit(y).alias("variable_2"), F.col(f"`{a}|{b}`").alias(out))
            for a, b in pairs for x, y in dict.fromkeys([(a, b), (b, a)])
        ])
        return wide.select(F.inline(rows))

    return matrix(full, "pearson").join(matrix(ranks, "spearman"), ["variable_1", "variable_2"])


def paired_difference(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Differences and ratios of two measures of the same rows."""
    ca, cb = F.col(a), F.col(b)
    ok = finite(a) & finite(b)
    ratio = F.when(ok & (cb != 0), ca / cb)
    base = df.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.avg(F.when(ok, ca - cb)).alias("mean_difference"), F.avg(ratio).alias("ratio_mean"),
        F.avg(F.when(ok, (ca < cb).cast("double"))).alias("share_a_lt_b"),
        F.avg(F.when(ok, (cb < ca).cast("double"))).alias("share_b_lt_a"),
    )
    parts = df.filter(ok).select(*keys, (ca - cb).alias("diff"), F.abs(ca - cb).alias("abs_diff"), ratio.alias("ratio"))
    long = parts.unpivot(keys, ["diff", "abs_diff", "ratio"], "what", "x")
    q = quantiles_long(long, keys + ["what"], [0.05, 0.5, 0.95])
    pick = lambda what, i: F.max(F.when(F.col("what") == what, F.col("q")[i]))
    qs = q.groupBy(*keys).agg(
        pick("diff", 1).alias("median_difference"), pick("abs_diff", 2).alias("p95_abs_difference"),
        pick("ratio", 1).alias("ratio_median"), pick("ratio", 0).alias("ratio_p05"), pick("ratio", 2).alias("ratio_p95"),
    )
    return base.join(qs, keys)


def stability(base: DataFrame, other: DataFrame, keys: list[str], ids: list[str], score: str, flag: str, min_rho: float = 0.90, max_mad: float = 0.25) -> DataFrame:
    """Agreement of a scenario with the baseline on common rows."""
    b = base.select(*keys, *ids, F.col(score).alias("s0"), F.col(flag).alias("f0"))
    j = materialise(b.join(other.select(*keys, *ids, F.col(score).alias("s1"), F.col(flag).alias("f1")), keys + ids), "scenario")
    agg = j.groupBy(*keys).agg(
        F.avg(F.abs(F.col("s0") - F.col("s1"))).alias("mean_abs_difference"),
        F.avg((F.col("f0") == F.col("f1")).cast("double")).alias("flag_agreement"),
        F.avg("s1").alias("scenario_mean"), F.stddev_samp("s1").alias("scenario_sd"),
    )
    p = pearson(j, keys, "s0", "s1")
    s = spearman(j, keys, "s0", "s1").drop("n")
    bad = (F.col("spearman") < min_rho) | (F.col("mean_abs_difference") > max_mad)
    return agg.join(p, keys).join(s, keys).withColumn(
        "stability_flag", F.when(bad, "REVIEW_SENSITIVITY").otherwise("STABLE")
    )


def slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Least-squares slope of y on x with a direction label; needs two distinct x."""
    ok = finite(x) & finite(y)
    fx, fy = F.when(ok, F.col(x).cast("double")), F.when(ok, F.col(y).cast("double"))
    out = df.groupBy(*keys).agg(
        F.count_if(ok).alias("n"), F.regr_slope(fy, fx).alias("_s"), (F.min(fx) < F.max(fx)).alias("_varies")
    ).withColumn("slope", F.when(F.col("_varies"), F.col("_s")))
    return out.select(
        *keys, "n", "slope",
        F.when(F.col("slope").isNull(), "insufficient_variation").when(F.col("slope") < 0, "decreases")
        .when(F.col("slope") > 0, "increases").otherwise("flat").alias("direction"),
    )


def extreme_counts(df: DataFrame, keys: list[str], measures: list[str], flags: list[str]) -> DataFrame:
    """Flag == 1 for flags; absolute value at or above its own 95th percentile for measures."""
    ks = keys + ["variable"]
    long = unpivot(df, keys, measures).filter(~missing("x")).withColumn("x", F.abs("x"))
    cut = quantiles_long(long, ks, [0.95]).select(*ks, F.col("q")[0].alias("cut"))
    m = long.join(F.broadcast(cut), ks).groupBy(*ks).agg(
        F.count("*").alias("n_obs"), F.count_if(F.col("x") >= F.col("cut")).alias("n_flagged")
    )
    f = unpivot(df, keys, flags).filter(~missing("x")).groupBy(*ks).agg(
        F.count("*").alias("n_obs"), F.count_if(F.col("x") == 1).alias("n_flagged")
    )
    return m.unionByName(f).withColumn("flag_rate", F.col("n_flagged") / F.col("n_obs"))


def ks_statistic(df: DataFrame, keys: list[str], value: str, side: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov D; ``side`` is a boolean column. Distinct values are scanned in order."""
    data = df.filter(~missing(value))
    counts = data.groupBy(*keys, value).agg(
        F.count_if(F.col(side)).alias("_ca"), F.count_if(~F.col(side)).alias("_cb")
    )
    tot = counts.groupBy(*keys).agg(F.sum("_ca").alias("n_a"), F.sum("_cb").alias("n_b"))
    cum = running(counts, keys, [F.col(value)], {"_fa": ("sum", "_ca"), "_fb": ("sum", "_cb")})
    j = cum.join(tot, keys) if keys else cum.crossJoin(tot)
    gap = F.abs(F.col("_fa") / F.col("n_a") - F.col("_fb") / F.col("n_b"))
    return j.filter("n_a > 0 and n_b > 0").groupBy(*keys, "n_a", "n_b").agg(F.max(gap).alias("ks_d"))
