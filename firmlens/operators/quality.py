"""Data-quality audits and gates. Gates are rows with a status; ``require`` turns a failing one into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions.columns import INF, all_present, finite, missing
from firmlens.operators.ordered import quantiles, unpivot


def column_audit(df: DataFrame, keys: list[str], cols: list[str], primary: list[str]) -> DataFrame:
    """NULL, NaN and infinity counts per column; requested columns that do not exist count as missing throughout."""
    have = [c for c in cols if c in df.columns]
    x = F.col("x")
    found = unpivot(df, keys, have).groupBy(*keys, "variable").agg(
        F.lit(True).alias("column_present"), F.count("*").alias("n_rows"), F.count_if(x.isNull()).alias("n_null"), F.count_if(F.isnan(x)).alias("n_nan"),
        F.count_if(x == INF).alias("n_pos_inf"), F.count_if(x == -INF).alias("n_neg_inf"), F.count_if(~finite("x")).alias("n_nonfinite"))
    lost = [c for c in cols if c not in df.columns]
    if lost:
        n = df.groupBy(*keys).agg(F.count("*").alias("n_rows"))
        zero = F.lit(0).cast("long")
        absent = n.select(*keys, F.explode(F.array(*[F.lit(c) for c in lost])).alias("variable"), F.lit(False).alias("column_present"), "n_rows",
                          F.col("n_rows").alias("n_null"), zero.alias("n_nan"), zero.alias("n_pos_inf"), zero.alias("n_neg_inf"), F.col("n_rows").alias("n_nonfinite"))
        found = found.unionByName(absent)
    return found.select("*", (F.col("n_nonfinite") / F.col("n_rows")).alias("share_nonfinite"), F.col("variable").isin(*primary).alias("primary_column"))


def row_audit(df: DataFrame, ids: list[str], primary: list[str]) -> DataFrame:
    """Rows with non-finite primary columns and how many."""
    bad = reduce(lambda a, b: a + b, [(~finite(c)).cast("int") for c in primary if c in df.columns])
    return df.select(*ids, bad.cast("long").alias("n_nonfinite_primary")).filter("n_nonfinite_primary > 0")


def finite_gate(audit: DataFrame, by: list[str], is_primary_source: Column) -> DataFrame:
    """FAIL on non-finite primary cells, then structural gaps, then secondary sources."""
    hit = lambda c: F.coalesce(F.bool_or(c & F.col("primary_column")), F.lit(False))
    bad = F.col("column_present") & (F.col("n_nonfinite") > 0)
    out = audit.groupBy(*by).agg(hit(is_primary_source & bad).alias("_p"), hit(is_primary_source & ~F.col("column_present")).alias("_s"), hit(~is_primary_source & bad).alias("_w"))
    return out.select(*by, F.when(F.col("_p"), "FAIL_NONFINITE_PRIMARY_COLUMNS").when(F.col("_s"), "PASS_WITH_STRUCTURAL_NA_ONLY")
                      .when(F.col("_w"), "WARN_SECONDARY_NONFINITE_ONLY").otherwise("PASS").alias("gate"))


def ratio_plausibility(df: DataFrame, keys: list[str], num: str, den: str, dependent: str) -> DataFrame:
    """Plausibility of num/den: medians, extreme shares, upper percentile, missing dependent variable."""
    base = df.withColumn("ratio", F.when(F.col(den) != 0, F.col(num) / F.col(den)))
    x = F.when(finite("ratio"), F.col("ratio"))
    ext = lambda t: F.avg(F.when(x.isNotNull(), ((x > t) | (x < 0)).cast("double")))
    a = base.groupBy(*keys).agg(
        F.count(x).alias("n_finite"), ext(5).alias("extreme_share"), ext(10).alias("very_extreme_share"), F.avg(missing(dependent).cast("double")).alias("missing_share"))
    q = quantiles(base, keys, ["ratio", num, den], [0.5, 0.99])
    pick = lambda v, i: F.max(F.when(F.col("variable") == v, F.col("q")[i]))
    p = q.groupBy(*keys).agg(pick("ratio", 0).alias("ratio_median"), pick("ratio", 1).alias("ratio_p99"), pick(num, 0).alias("num_median"), pick(den, 0).alias("den_median"))
    j = a.join(p, keys, "left") if keys else a.crossJoin(p)
    c = F.col
    suspect = [("too few finite ratios", c("n_finite") < 100), ("median ratio above 2", c("ratio_median") > 2), ("median denominator below median numerator", c("den_median") < c("num_median"))]
    tail = [("more than 5% beyond 5 or negative", c("extreme_share") > 0.05), ("more than 2% beyond 10 or negative", c("very_extreme_share") > 0.02),
            ("99th percentile above 10", c("ratio_p99") > 10), ("dependent variable mostly missing", c("missing_share") > 0.5)]
    any_of = lambda rules: reduce(lambda p, q: p | q, [F.coalesce(r, F.lit(False)) for _, r in rules])
    status = F.when(any_of(suspect), "REVIEW_REQUIRED").when(any_of(tail), "PASS_MAIN_SECONDARY_REVIEW").otherwise("PASS")
    return j.select("*", status.alias("status"), F.concat_ws("; ", *[F.when(r, n) for n, r in suspect + tail]).alias("reasons"))


def lost_only_because_of(df: DataFrame, others: list[str], col: str) -> DataFrame:
    return df.agg(F.count_if(all_present(others)).alias("n_others_complete"), F.count_if(all_present(others) & missing(col)).alias("n_lost"))


def count_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    b = before.groupBy(*keys).agg(F.count("*").alias("n_before"))
    a = after.groupBy(*keys).agg(F.count("*").alias("n_after"))
    j = b.join(a, keys, "full").fillna(0, ["n_before", "n_after"])
    return j.select("*", (F.col("n_after") - F.col("n_before")).alias("difference"),
                    F.when(F.col("n_before") > 0, 100 * (F.col("n_after") - F.col("n_before")) / F.col("n_before")).alias("pct_change"))


def provenance(fact: DataFrame, dim: DataFrame, key: str, category: str, allowed: list[str], keywords: str) -> DataFrame:
    """Category coverage of a dimension: allowed set, facts matched, and names hit by a keyword screen."""
    per = fact.groupBy(key).agg(F.count("*").alias("n"))
    j = dim.join(per, key, "left")
    return j.groupBy(category).agg(
        F.count("*").alias("n_keys"), F.count("n").alias("n_keys_with_facts"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_facts"),
        F.count_if(F.col(category).rlike(keywords)).alias("n_keyword_hits"),
    ).withColumn("allowed", F.col(category).isin(*allowed))


def design_completeness(manifest: DataFrame, results: DataFrame, cell: list[str], sides: list[str], rep: str = "replication", side: str = "validation_target") -> DataFrame:
    """Expected against observed replications of every design cell: missing, extra, duplicated, unpaired."""
    want = manifest.select(*cell, F.explode(F.sequence("rep_start", "rep_end")).alias(rep), F.lit(1).alias("_e"))
    got = results.groupBy(*cell, rep).agg(
        F.count("*").alias("_rows"), F.count_distinct(side).alias("_sides"), F.count_if(~F.col(side).isin(*sides)).alias("_odd"))
    j = want.join(got, cell + [rep], "full")
    out = j.groupBy(*cell).agg(
        F.count("_e").alias("expected_replications"), F.count_if(F.col("_rows").isNotNull()).alias("observed_replications"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("observed_rows"),
        F.count_if(F.col("_e").isNotNull() & F.col("_rows").isNull()).alias("n_missing"), F.count_if(F.col("_e").isNull()).alias("n_extra"),
        F.coalesce(F.sum(F.col("_rows") - F.col("_sides")), F.lit(0)).alias("n_duplicates"),
        F.count_if(F.col("_rows").isNotNull() & ((F.col("_sides") != len(sides)) | (F.col("_odd") > 0))).alias("n_unpaired"))
    return out.withColumn("complete", (F.col("n_missing") == 0) & (F.col("n_extra") == 0) & (F.col("n_duplicates") == 0) & (F.col("n_unpaired") == 0))


def blockers(tasks: DataFrame, keys: list[str], status: str = "status", ok: tuple = ("SUCCESS",)) -> DataFrame:
    """Failing tasks, one row each, with the number of blocking tasks of their group; no list is ever gathered."""
    bad = tasks.filter(~F.coalesce(F.col(status).isin(*ok), F.lit(False))).select(*keys, "task_key", F.coalesce(status, F.lit("MISSING")).alias("status"))
    n = bad.groupBy(*keys).agg(F.count("*").alias("n_blocking"))
    return bad.join(n, keys)


def require(gate: DataFrame, failing: Column, message: str) -> DataFrame:
    bad = gate.filter(failing).limit(1).collect()
    if bad:
        raise ValueError(f"{message}: {bad[0].asDict()}")
    return gate


def suppression(quantities: DataFrame, verification: DataFrame, key: str) -> DataFrame:
    """Required quantities that are not verified are suppressed."""
    j = quantities.join(verification, key, "left").withColumn("verified", F.coalesce("verified", F.lit(False)))
    return j.withColumn("report_status", F.when(~F.col("required"), "not_required").when(F.col("verified"), "reported").otherwise("suppressed"))


def identical_outcomes(df: DataFrame, cols: list[str], tol: float = 1e-12, min_rows: int = 10) -> DataFrame:
    """Pairs of outcome columns that agree numerically on their jointly finite rows."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    aggs = []
    for i, (a, b) in enumerate(pairs):
        ok = finite(a) & finite(b)
        aggs += [F.count_if(ok).alias(f"n{i}"), F.max(F.when(ok, F.abs(F.col(a) - F.col(b)))).alias(f"d{i}")]
    rows = F.array(*[F.struct(F.lit(a).alias("outcome_1"), F.lit(b).alias("outcome_2"), F.col(f"n{i}").alias("n_joint"), F.col(f"d{i}").alias("max_abs_difference")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*aggs).select(F.inline(rows)).withColumn("identical", (F.col("n_joint") > min_rows) & (F.col("max_abs_difference") <= tol))


def extraction_guardrail(coefs: DataFrame, by: list[str], value: str = "estimate", status: str = "model_status", min_share: float = 0.5) -> DataFrame:
    ok = F.col(status) == "fit_ok"
    a = coefs.groupBy(*by).agg(F.count_if(ok).alias("n_fit_ok"), F.count_if(ok & finite(value)).alias("n_finite"))
    return a.withColumn("guardrail_pass", (F.col("n_fit_ok") == 0) | (F.col("n_finite") >= min_share * F.col("n_fit_ok")))


def checklist(checks: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """One row per named check from single-row frames holding ``ok`` and ``detail``."""
    parts = [df.select(F.lit(i).alias("check_id"), F.lit(n).alias("check_name"), F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("status"), "detail") for i, n, df in checks]
    return reduce(lambda a, b: a.unionByName(b), parts)


def roll_up(decisions: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    has = lambda s: F.coalesce(F.bool_or(F.col(status).startswith(s)), F.lit(False))
    return decisions.groupBy(*by).agg(F.count("*").alias("n_rows"), F.when(has("FAIL"), "FAIL").when(has("WARN"), "WARN").otherwise("PASS").alias("overall"))


def best_profile(runs: DataFrame, keys: list[str], status: str, cost: list[str], baseline: Column) -> DataFrame:
    """Best acceptable profile: PASS before REVIEW, non-baseline before baseline, then cost."""
    order = F.struct(F.when(F.col(status) == "PASS", 0).otherwise(1), baseline.cast("int"), *[F.col(c) for c in cost], F.col("profile"))
    return runs.filter(F.col(status).isin("PASS", "REVIEW")).groupBy(*keys).agg(F.min_by("profile", order).alias("best_profile"), F.count("*").alias("n_acceptable"))


def minimum_eligibility(grid: DataFrame, counts: DataFrame, keys: list[str], minimum: int = 2) -> DataFrame:
    j = grid.join(counts, keys, "left").withColumn("n_eligible", F.coalesce("n_eligible", F.lit(0)).cast("long"))
    return j.withColumn("eligible", F.col("n_eligible") >= minimum)


def drift_check(a: DataFrame, b: DataFrame, by: list[str], name: str, value: str, max_diff: float = 0.005, totals: tuple[DataFrame, DataFrame] | None = None, max_shift: float = 10.0) -> DataFrame:
    """Largest coefficient difference between two tables after mapping names to a common form, and the shift of their score totals.

    ``totals`` are (by, total) of both runs. A difference of ``max_diff`` or more blocks, as does a shift of ``max_shift`` or more in either direction; a
    total that one run lacks blocks too.
    """
    norm = lambda df, out: df.select(*by, F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_").alias("_n"), F.col(value).alias(out))
    j = norm(a, "va").join(norm(b, "vb"), by + ["_n"])
    out = j.groupBy(*by).agg(F.count("*").alias("n_matched"), F.max(F.abs(F.col("va") - F.col("vb"))).alias("max_abs_difference"))
    blocked = F.col("max_abs_difference") >= max_diff
    if totals is None:
        return out.withColumn("blocked", blocked)
    ta, tb = (t.select(*by, F.col("total").alias(n)) for t, n in zip(totals, ("_ta", "_tb")))
    shift = F.col("_tb") - F.col("_ta")
    far = F.coalesce(F.abs("total_shift") >= max_shift, F.lit(True))
    return out.join(ta, by, "left").join(tb, by, "left").withColumn("total_shift", shift).withColumn("shift_blocked", far).withColumn("blocked", blocked | far).drop("_ta", "_tb")


def status_counts(df: DataFrame, stage: str, status: str) -> DataFrame:
    return df.groupBy(F.lit(stage).alias("stage"), F.col(status).alias("status")).agg(F.count("*").alias("n"))
