"""Deterministic cross-validation folds, their audits and train-side statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions.columns import order_hash
from firmlens.operators.aggregates import dominant_category
from firmlens.operators.aggregates import distribution_text
from firmlens.operators.ordered import rank_rows

SEED = 42


def hash_fold(h: Column, k: int) -> Column:
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % k + 1).cast("int")


def grouped_folds(df: DataFrame, k: int, seed: int = SEED, stratified: bool = True, firm: str = "company", stratum: str = "industry") -> DataFrame:
    """Whole firms dealt round-robin in hash order, inside each stratum or over all firms.

    A firm's stratum is the one most of its rows name, the first alphabetically on ties. The deal uses distributed ranks, so one stratum may hold any share of the firms.
    """
    firms = dominant_category(df, firm, stratum).select(firm, F.col(f"dominant_{stratum}").alias(stratum))
    h = order_hash(seed, "grouped", F.col(firm))
    ranked = rank_rows(firms.withColumn("_h", h), [stratum] if stratified else [], [F.col("_h"), F.col(firm)], "_r")
    return ranked.select(firm, stratum, ((F.col("_r") - 1) % k + 1).cast("int").alias("fold_id"))


def row_folds(df: DataFrame, k: int, seed: int = SEED, firm: str = "company", keys: list[str] | None = None) -> DataFrame:
    """Rows of a firm spread over folds 1..min(k, n) in hash order; a single row gets a hashed fold."""
    keys = keys or []
    h = order_hash(seed, "row", F.col(firm), F.col("year").cast("string"))
    # Bounded group: a firm has at most one row per calendar year.
    whole = W.partitionBy(*keys, firm)
    pos = F.row_number().over(whole.orderBy("_h", "year"))
    n = F.count("*").over(whole)
    fold = F.when(n == 1, hash_fold(F.col("_h"), k)).otherwise(((pos - 1) % F.least(n, F.lit(k)) + 1).cast("int"))
    return df.withColumn("_h", h).withColumn("fold_id", fold).drop("_h")


def plain_row_folds(df: DataFrame, k: int, seed: int = SEED, ids: list[str] = ["company", "year"]) -> DataFrame:
    h = order_hash(seed, "plain", *[F.col(c).cast("string") for c in ids])
    ranked = rank_rows(df.withColumn("_h", h), [], [F.col("_h"), *[F.col(c) for c in ids]], "_r")
    return ranked.withColumn("fold_id", ((F.col("_r") - 1) % k + 1).cast("int")).drop("_h", "_r")


def complement(own: DataFrame, keys: list[str], fold: str, sums: list[str]) -> DataFrame:
    """Train-side sums of every fold in one pass: total minus own. ``own`` is one row per (keys, fold)."""
    total = own.groupBy(*keys).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    j = own.join(total, keys) if keys else own.crossJoin(total)
    return j.select(*keys, fold, *[(F.col(f"_t_{s}") - F.col(s)).alias(f"train_{s}") for s in sums])


def fold_balance(df: DataFrame, keys: list[str], firm: str = "company") -> DataFrame:
    """Firms, rows, rows per firm, year range and distribution texts of every fold."""
    ks = keys + ["fold_id"]
    # Rows per firm are bounded by the number of years, so the median counts few distinct values.
    per_firm = df.groupBy(*ks, firm).agg(F.count("*").alias("n"), F.min("year").alias("y0"), F.max("year").alias("y1"))
    base = per_firm.groupBy(*ks).agg(
        F.count("*").alias("n_firms"), F.sum("n").alias("n_obs"), F.min("n").alias("min_obs_per_firm"),
        F.percentile("n", 0.5).alias("median_obs_per_firm"), F.max("n").alias("max_obs_per_firm"),
        F.min("y0").alias("min_year"), F.max("y1").alias("max_year"),
    )
    years = distribution_text(df, ks, "year", "year_distribution", sep=";", eq=":", by_key=True)
    inds = distribution_text(df, ks, "industry", "industry_distribution", sep=";", eq="=")
    return base.join(years, ks).join(inds, ks)


def fold_diagnostics(df: DataFrame, keys: list[str], firm: str = "company", min_firms: int = 20) -> DataFrame:
    """Industry coverage of the test part, industries absent from training, imbalance of sizes."""
    ks = keys + ["fold_id"]
    cell = df.groupBy(*ks, "industry", "year").agg(F.count("*").alias("n"))
    ind = cell.groupBy(*ks, "industry").agg(F.sum("n").alias("n_ind"), F.count("*").alias("cells"))
    wide = ind.groupBy(*ks).agg(
        F.count("*").alias("n_industries"), F.sum("cells").alias("n_industry_year_cells"),
        (F.max("n_ind") / F.sum("n_ind")).alias("largest_industry_share"), F.sum("n_ind").alias("n_obs"),
    )
    firms = df.select(*ks, firm).distinct().groupBy(*ks).agg(F.count("*").alias("n_firms"))
    # An industry is absent from training when every one of its rows sits in this fold.
    total = ind.groupBy(*keys, "industry").agg(F.sum("n_ind").alias("t"))
    lost = ind.join(total, keys + ["industry"]).groupBy(*ks).agg(
        F.count_if(F.col("n_ind") == F.col("t")).alias("n_industries_absent_from_training")
    )
    out = wide.join(firms, ks).join(lost, ks)
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))  # one row per fold
    return out.select(
        "*", (F.col("n_firms") < min_firms).alias("too_few_firms"),
        (F.max("n_obs").over(w) / F.min("n_obs").over(w)).alias("obs_imbalance_ratio"),
        (F.max("n_firms").over(w) / F.min("n_firms").over(w)).alias("firm_imbalance_ratio"),
    )


def stratum_coverage(df: DataFrame, keys: list[str], k: int, firm: str = "company", stratum: str = "industry") -> DataFrame:
    return df.groupBy(*keys, stratum).agg(
        F.count_distinct(firm).alias("n_firms"), F.count_distinct("fold_id").alias("n_folds")
    ).select(
        "*", (F.col("n_folds") == k).alias("in_every_fold"),
        F.when(F.col("n_firms") < k, "BLOCK_SPARSE_STRATUM").otherwise("OK").alias("stratum_status"),
    )


def level_coverage(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Test levels never seen in training: rows (column_name, level, n_rows)."""
    out = None
    for c in cols:
        seen = train.select(F.col(c).alias("level")).distinct()
        miss = test.select(F.col(c).alias("level")).join(seen, "level", "left_anti").groupBy("level").agg(F.count("*").alias("n_rows"))
        part = miss.select(F.lit(c).alias("column_name"), F.col("level").cast("string").alias("level"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


def assert_levels_covered(train: DataFrame, test: DataFrame, cols: list[str]) -> None:
    bad = level_coverage(train, test, cols).limit(1).collect()
    if bad:
        raise ValueError(f"held-out {bad[0].column_name} level {bad[0].level} is absent from training")


def split_firms(df: DataFrame, keys: list[str], firm: str = "company") -> DataFrame:
    """Firms found in more than one fold."""
    return df.groupBy(*keys, firm).agg(F.count_distinct("fold_id").alias("n_folds")).filter("n_folds > 1")


def history_flags(df: DataFrame, keys: list[str], firm: str = "company") -> DataFrame:
    """Whether the firm of a held-out row has rows in other folds; only such rows are primary targets."""
    per = df.groupBy(*keys, firm, "fold_id").agg(F.count("*").alias("_own"))
    tot = per.groupBy(*keys, firm).agg(F.sum("_own").alias("_all"))
    j = per.join(tot, keys + [firm])
    flag = F.col("_all") > F.col("_own")
    j = j.select(*keys, firm, "fold_id", flag.alias("same_firm_history_available"))
    return df.join(j, keys + [firm, "fold_id"]).withColumn(
        "new_company_in_row_fold", ~F.col("same_firm_history_available")
    ).withColumn("primary_row_target_inclusion", F.col("same_firm_history_available"))
