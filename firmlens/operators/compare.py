"""Matched top-share comparison of two scores, membership classes, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.columns import correlation, finite
from firmlens.operators.ordered import rank_rows
from firmlens.session import materialise

EPS = 2.220446049250313e-16


def transform_score(c: Column, transform: str) -> Column:
    if transform == "absolute_value":
        return F.abs(c)
    if transform == "inverse_tail_probability":
        return F.lit(1.0) - c
    return c


def top_n(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.ceil(n * F.lit(share))).cast("long")


def ranked_scores(df: DataFrame, keys: list[str], score: str, ids: list[str] = ["company", "year"], share: float = 0.05, nonfinite_last: bool = False, average: bool = False) -> DataFrame:
    """Total-order rank (score down, then ids) with the top-share flag, and the ``average_rank`` of equal scores if wanted.

    Non-finite scores are dropped, or ranked last when ``nonfinite_last`` is set.
    """
    s = F.when(finite(score), F.col(score)).otherwise(F.lit(float("-inf"))) if nonfinite_last else F.col(score)
    base = df.withColumn(score, s) if nonfinite_last else df.filter(finite(score))
    ranked = rank_rows(base, keys, [F.desc(score), *[F.col(c) for c in ids]], tied=score if average else None)
    n = base.groupBy(*keys).agg(F.count("*").alias("n"))
    j = ranked.join(n, keys)
    return j.withColumn("top_n", top_n(F.col("n"), share)).withColumn("top_flag", F.col("rank") <= F.col("top_n"))


def cutoff_ties(ranked: DataFrame, keys: list[str], score: str) -> DataFrame:
    """How many rows share the score found at rank top_n."""
    cut = ranked.filter(F.col("rank") == F.col("top_n")).select(*keys, F.col(score).alias("_cut"))
    return ranked.join(F.broadcast(cut), keys).groupBy(*keys).agg(
        F.max("top_n").alias("top_n"), F.max("_cut").alias("cutoff_score"),
        F.count_if(F.col(score) == F.col("_cut")).alias("cutoff_tie_count"),
    ).withColumn("cutoff_tie_flag", F.col("cutoff_tie_count") > 1)


def _both_sides(df: DataFrame, keys: list[str], a: str, b: str, ids: list[str], share: float) -> DataFrame:
    """Both scores of every jointly finite row, ranked in one sorted scan: (keys, ids, side, score, rank ...)."""
    return materialise(ranked_scores(_joint(df, keys, a, b, ids), keys + ["side"], "score", ids, share, average=True), "ranked")


def _joint(df: DataFrame, keys: list[str], a: str, b: str, ids: list[str]) -> DataFrame:
    return df.filter(finite(a) & finite(b)).select(
        *keys, *ids, F.inline(F.array(
            F.struct(F.lit("a").alias("side"), F.col(a).cast("double").alias("score")),
            F.struct(F.lit("b").alias("side"), F.col(b).cast("double").alias("score")),
        ))
    )


def packed_membership(df: DataFrame, keys: list[str], slots: list[tuple], a: str, b: str, firm: str = "company", year: str = "year", share: float = 0.05) -> DataFrame:
    """:func:`membership` with one row per firm: (firm, marks: year -> bits).

    Each of ``slots``, values of ``keys``, owns three bits in order: the firm-year is ranked there, it is in the top set of ``a``, in that of ``b``. Of the ranks
    only these bits are shuffled, once, by firm. Firm-years are unique, so a firm has at most as many marks as there are years.
    """
    ranked = ranked_scores(_joint(df, keys, a, b, [firm, year]), keys + ["side"], "score", [firm, year], share)
    here = lambda slot: F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]) == "\x1f".join(map(str, slot))
    at = lambda value: F.coalesce(*[F.when(here(slot), F.lit(value << 3 * i)) for i, slot in enumerate(slots)]).cast("long")
    top = F.col("top_flag")
    bits = F.when(F.col("side") == "a", F.when(top, at(3)).otherwise(at(1))).otherwise(F.when(top, at(4)).otherwise(F.lit(0).cast("long")))
    each = ranked.select(firm, year, bits.alias("bits")).where("bits > 0").repartition(firm)
    marks = each.groupBy(firm, year).agg(F.sum("bits").alias("bits"))
    return marks.groupBy(firm).agg(F.map_from_entries(F.collect_list(F.struct(year, "bits"))).alias("marks"))


def _membership(ranked: DataFrame, keys: list[str], ids: list[str]) -> DataFrame:
    side = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    wide = ranked.groupBy(*keys, *ids).agg(
        F.max("n").alias("n"), F.max("top_n").alias("top_n"),
        *[side(s, c).alias(f"{c}_{s}") for s in "ab" for c in ("score", "rank", "top_flag")],
    )
    fa, fb = F.col("top_flag_a"), F.col("top_flag_b")
    cls = F.when(fa & fb, "both").when(fa, "a_only").when(fb, "b_only").otherwise("neither")
    return wide.withColumn("membership_class", cls)


def membership(df: DataFrame, keys: list[str], a: str, b: str, ids: list[str] = ["company", "year"], share: float = 0.05) -> DataFrame:
    return _membership(_both_sides(df, keys, a, b, ids, share), keys, ids)


def matched_comparison(df: DataFrame, keys: list[str], a: str, b: str, ids: list[str] = ["company", "year"], share: float = 0.05) -> DataFrame:
    """Overlap of two equally large top sets per key, with switch rate, Spearman and cut-off ties."""
    ranked = _both_sides(df, keys, a, b, ids, share)
    ks = keys + ["side"]
    cls = F.col("membership_class")
    sets = _membership(ranked, keys, ids).groupBy(*keys).agg(
        F.max("n").alias("n_joined"), F.max("top_n").alias("top_n"),
        F.count_if("top_flag_a").alias("a_top_n"), F.count_if("top_flag_b").alias("b_top_n"),
        F.count_if(cls == "both").alias("intersection_n"), F.count_if(cls != "neither").alias("union_n"),
        F.count_if(cls == "a_only").alias("only_a_n"), F.count_if(cls == "b_only").alias("only_b_n"),
        F.count_if(cls == "neither").alias("neither_n"),
    )
    mean_rank = ranked.groupBy(*keys, *ids).agg(
        F.max(F.when(F.col("side") == "a", F.col("average_rank"))).alias("_ra"),
        F.max(F.when(F.col("side") == "b", F.col("average_rank"))).alias("_rb"),
    )
    rho = mean_rank.groupBy(*keys).agg(correlation("_ra", "_rb").alias("spearman"))
    ties = cutoff_ties(ranked, ks, "score").groupBy(*keys).agg(
        F.max(F.when(F.col("side") == "a", F.col("cutoff_tie_count"))).alias("cutoff_tie_count_a"),
        F.max(F.when(F.col("side") == "b", F.col("cutoff_tie_count"))).alias("cutoff_tie_count_b"),
    )
    out = sets.join(rho, keys).join(ties, keys)
    return out.select(
        "*", (F.col("top_n") / F.col("n_joined")).alias("effective_top_share"),
        F.when(F.col("union_n") > 0, F.col("intersection_n") / F.col("union_n")).alias("jaccard"),
        ((F.col("only_a_n") + F.col("only_b_n")) / F.col("n_joined")).alias("switch_rate"),
    )


def invariants(comparison: DataFrame) -> DataFrame:
    c = F.col
    ok = (
        (c("a_top_n") == c("top_n")) & (c("b_top_n") == c("top_n"))
        & (c("union_n") == 2 * c("top_n") - c("intersection_n")) & (c("neither_n") == c("n_joined") - c("union_n"))
    )
    return comparison.withColumn("invariants_hold", ok)


def assert_invariants(comparison: DataFrame, keys: list[str]) -> DataFrame:
    bad = invariants(comparison).filter(~F.col("invariants_hold")).limit(1).collect()
    if bad:
        raise ValueError(f"matched-size invariant failed for {[bad[0][k] for k in keys]}")
    return comparison


def flag_overlap(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Overlap of two natural binary flags, without matching sizes."""
    use = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    fa, fb = F.col(a) > 0, F.col(b) > 0
    out = use.groupBy(*keys).agg(
        F.count("*").alias("n_joined"), F.count_if(fa).alias("a_flag_n"), F.count_if(fb).alias("b_flag_n"),
        F.count_if(fa & fb).alias("intersection_n"), F.count_if(fa | fb).alias("union_n"),
        F.count_if(fa & ~fb).alias("only_a_n"), F.count_if(~fa & fb).alias("only_b_n"),
    )
    return out.select(
        "*", F.when(F.col("union_n") > 0, F.col("intersection_n") / F.col("union_n")).alias("jaccard"),
        ((F.col("only_a_n") + F.col("only_b_n")) / F.col("n_joined")).alias("switch_rate"),
    )


# Jaccard thresholds of the decisions.
LOW, MODERATE = 0.60, 0.80


def materiality(jaccard: Column) -> Column:
    return F.when(jaccard.isNull(), "not_available").when(jaccard < LOW, "low").when(jaccard < MODERATE, "moderate").otherwise("high")


def primary_decision(comparison: DataFrame, by: list[str]) -> DataFrame:
    low, mid = F.col("jaccard") < LOW, (F.col("jaccard") < MODERATE) & (F.col("jaccard") >= LOW)
    agg = comparison.groupBy(*by).agg(F.count("*").alias("n_metrics"), F.bool_or(low).alias("_l"), F.bool_or(mid).alias("_m"), F.min("jaccard").alias("min_jaccard"))
    return agg.select(
        *by, "n_metrics", "min_jaccard",
        F.when(F.col("_l"), "WARN_PRIMARY_MAGNITUDE_JACCARD_LOW").when(F.col("_m"), "WARN_PRIMARY_MAGNITUDE_JACCARD_MODERATE")
        .otherwise("PASS_PRIMARY_MAGNITUDE_RECLASSIFICATION_AVAILABLE").alias("decision"),
    )


def denominator_perturbed(joined: DataFrame, keys: list[str], ids: list[str] = ["company", "year"]) -> DataFrame:
    """Matched comparison of |raw / denominator| under six denominators, all variants in one job.

    ``joined`` holds raw_a, raw_b, den_a, den_b.
    """
    from firmlens.operators.prep import denominator_variants

    names = ["original", "winsor_1_99", "winsor_5_95", "floor_p01", "floor_p05", "median"]
    cur = joined.select(*keys, *ids, "raw_a", "raw_b", "den_a", "den_b")
    for s in "ab":
        v = denominator_variants(cur, keys, f"den_{s}")
        cur = v.select(*cur.columns, *[F.col(f"den_{n}").alias(f"{n}_{s}") for n in names])
    score = lambda n, s: F.abs(F.col(f"raw_{s}") / F.greatest(F.col(f"{n}_{s}"), F.lit(EPS)))
    long = cur.select(*keys, *ids, F.inline(F.array(*[
        F.struct(F.lit(n).alias("denominator"), score(n, "a").alias("sa"), score(n, "b").alias("sb")) for n in names
    ])))
    return matched_comparison(long, keys + ["denominator"], "sa", "sb", ids)


def denominator_decision(cmp: DataFrame, keys: list[str]) -> DataFrame:
    orig = F.col("denominator") == "original"
    agg = cmp.groupBy(*keys).agg(
        F.max(F.when(orig, F.col("jaccard"))).alias("original_jaccard"),
        F.min(F.when(~orig, F.col("jaccard"))).alias("min_jaccard"), F.max(F.when(~orig, F.col("jaccard"))).alias("max_jaccard"),
    )
    inc = F.col("max_jaccard") - F.col("original_jaccard")
    out = agg.select(
        "*", (F.col("max_jaccard") - F.col("min_jaccard")).alias("jaccard_range"), inc.alias("max_increase"),
        (inc >= 0.20).alias("denominator_sensitive"),
        ((F.col("original_jaccard") < LOW) & (F.col("max_jaccard") >= MODERATE)).alias("denominator_driven"),
    )
    return out.withColumn(
        "assessment",
        F.when(F.col("denominator_driven"), "FAIL_DENOMINATOR_DRIVEN").when(F.col("denominator_sensitive"), "WARN_DENOMINATOR_SENSITIVE")
        .otherwise("PASS_DENOMINATOR_DIAGNOSTIC_STABLE"),
    )


def compare_with_baseline(variant: DataFrame, baseline: DataFrame, keys: list[str] = ["target_space", "metric"], strict: bool = True) -> DataFrame:
    """Jaccard of a variant run against the baseline run; a key without baseline is an error."""
    v = variant.select(*keys, F.col("jaccard").alias("variant_jaccard"))
    b = baseline.select(*keys, F.col("jaccard").alias("baseline_jaccard"))
    if strict:
        lost = v.join(b.filter(finite("baseline_jaccard")), keys, "left_anti").limit(1).collect()
        if lost:
            raise ValueError(f"no baseline Jaccard for {lost[0].asDict()}")
    j = v.join(b, keys, "left")
    diff = F.col("variant_jaccard") - F.col("baseline_jaccard")
    mat = lambda c: finite(c) & (F.col(c) < MODERATE)
    out = j.select(
        "*", diff.alias("difference"), mat("baseline_jaccard").alias("baseline_material"), mat("variant_jaccard").alias("variant_material"),
    ).withColumn("conclusion_unchanged", F.col("baseline_material") == F.col("variant_material"))
    fail = ~finite("baseline_jaccard") | ~finite("variant_jaccard") | (F.col("variant_jaccard") >= MODERATE)
    warn = ~F.col("conclusion_unchanged") | (F.abs("difference") > 0.10)
    return out.withColumn("decision", F.when(fail, "FAIL").when(warn, "WARN").otherwise("PASS"))


def shift_comparison(weights: DataFrame, by: list[str]) -> DataFrame:
    """Firm-intercept weight under row minus grouped validation per run, from a long weight table
    (run, target_space, scheme, variant, model_id, weight)."""
    from firmlens.functions.naming import FIRM_RE

    re = F.col("variant") == FIRM_RE
    agg = weights.groupBy(*by).agg(
        F.sum(F.when(re & (F.col("scheme") == "row"), F.col("weight")).otherwise(0.0)).alias("row_firm_re"),
        F.sum(F.when(re & (F.col("scheme") == "grouped"), F.col("weight")).otherwise(0.0)).alias("grouped_firm_re"),
        F.min_by("model_key", F.struct(F.when(F.col("scheme") == "row", -F.col("weight")).otherwise(1.0), F.col("model_key"))).alias("top_row"),
        F.min_by("model_key", F.struct(F.when(F.col("scheme") == "grouped", -F.col("weight")).otherwise(1.0), F.col("model_key"))).alias("top_grouped"),
    )
    return agg.withColumn("firm_re_shift", F.col("row_firm_re") - F.col("grouped_firm_re"))


def shift_agreement(base: DataFrame, variant: DataFrame, keys: list[str], relative: float = 0.70) -> DataFrame:
    """Whether a variant run keeps the firm-intercept shift of the base run."""
    ren = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in ("firm_re_shift", "top_row", "top_grouped")])
    j = ren(base, "base").join(ren(variant, "variant"), keys)
    ratio = F.when(F.abs("firm_re_shift_base") > 1e-9, F.col("firm_re_shift_variant") / F.col("firm_re_shift_base"))
    return j.select(
        "*", ratio.alias("shift_ratio"), (F.coalesce(ratio, F.lit(0.0)) >= relative).alias("retains_shift"),
        (F.signum("firm_re_shift_base") == F.signum("firm_re_shift_variant")).alias("same_direction"),
        (F.col("top_row_base") == F.col("top_row_variant")).alias("same_top_row"),
        (F.col("top_grouped_base") == F.col("top_grouped_variant")).alias("same_top_grouped"),
    )


def jaccard_decomposition(joined: DataFrame, keys: list[str], ids: list[str] = ["company", "year"]) -> DataFrame:
    """Jaccard with own scores, with swapped numerators and with swapped denominators."""
    q = lambda n, d: F.abs(F.col(f"raw_{n}") / F.greatest(F.col(f"den_{d}"), F.lit(EPS)))
    pairs = [("own", q("a", "a"), q("b", "b")), ("same_denominator", q("a", "a"), q("b", "a")), ("same_numerator", q("a", "a"), q("a", "b"))]
    long = joined.select(*keys, *ids, F.inline(F.array(*[F.struct(F.lit(n).alias("pair"), x.alias("sa"), y.alias("sb")) for n, x, y in pairs])))
    return matched_comparison(long, keys + ["pair"], "sa", "sb", ids)


def strict_space(weights: DataFrame, groups: list[str], rules: list[tuple[str, Column]]) -> DataFrame:
    """Full against strict model space: ordered exclusion reasons and renormalised weights in both."""
    from pyspark.sql import Window as W

    reason = None
    for name, cond in rules:
        reason = F.when(cond, name) if reason is None else reason.when(cond, name)
    w = W.partitionBy(*groups)  # candidate models of one space
    out = weights.withColumn("exclusion_reason", reason).withColumn("strict_included", F.col("exclusion_reason").isNull())
    kept = F.when(F.col("strict_included"), F.col("weight")).otherwise(0.0)
    return out.withColumn("full_weight", F.col("weight") / F.sum("weight").over(w)).withColumn(
        "strict_weight", F.when(F.sum(kept).over(w) > 0, kept / F.sum(kept).over(w)))


def strict_space_summary(strict: DataFrame, groups: list[str]) -> DataFrame:
    from firmlens.functions.naming import FIRM_RE

    re = (F.col("variant") == FIRM_RE).cast("double")
    out = strict.groupBy(*groups).agg(
        F.count("*").alias("n_full"), F.count_if("strict_included").alias("n_strict"),
        F.sum(F.col("full_weight") * re).alias("full_firm_re"), F.sum(F.col("strict_weight") * re).alias("strict_firm_re"),
    )
    return out.select(
        "*", (F.col("strict_firm_re") - F.col("full_firm_re")).alias("firm_re_shift"),
        F.when(F.col("full_firm_re") > 0, F.col("strict_firm_re") / F.col("full_firm_re")).alias("firm_re_ratio"),
    )
