"""Joins with the checks that guard them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Fail with one example key; only that example reaches the driver."""
    example = duplicate_keys(df, keys).limit(1).collect()
    if example:
        raise ValueError(f"{label}: key {keys} is not unique, e.g. {example[0].asDict()}")
    return df


def dimension_join(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join on a key that is unique in ``dim``; join side sizes are left to adaptive execution."""
    return fact.join(assert_unique(dim, [key], "dimension"), key, "left")


def dimension_join_report(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    joined = fact.join(dim, key, "left")
    before = fact.agg(F.count("*").alias("n_before"))
    after = joined.agg(F.count("*").alias("n_after"))
    dup = duplicate_keys(dim, [key]).agg(F.count("*").alias("n_duplicate_keys"))
    return before.crossJoin(after).crossJoin(dup)


def suffixed_join(left: DataFrame, right: DataFrame, keys: list[str], lsuf: str, rsuf: str, how: str = "inner") -> DataFrame:
    both = (set(left.columns) & set(right.columns)) - set(keys)
    ren = lambda df, suf: df.select(*[F.col(c).alias(c + suf) if c in both else F.col(c) for c in df.columns])
    return ren(left, lsuf).join(ren(right, rsuf), keys, how)


def join_coverage(left: DataFrame, right: DataFrame, keys: list[str], groups: list[str]) -> DataFrame:
    """Per group: sizes of both sides, matches and rows left over on each side, in one full join."""
    on = list(dict.fromkeys(groups + keys))
    j = left.select(*on, F.lit(1).alias("_l")).join(right.select(*on, F.lit(1).alias("_r")), on, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return j.groupBy(*groups).agg(
        F.count("_l").alias("left_n"), F.count("_r").alias("right_n"), F.count_if(both).alias("matched_n"),
        F.count_if(F.col("_r").isNull()).alias("left_unmatched_n"), F.count_if(F.col("_l").isNull()).alias("right_unmatched_n"),
    )


def planning_grid(*factors: DataFrame) -> DataFrame:
    """Every combination of a few short factor lists (design factors, not data rows)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), factors)


def full_weights(left: DataFrame, right: DataFrame, keys: list[str], weights: tuple[str, str], labels: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Full join of two weight tables: a missing weight is 0, a missing rank stays NULL."""
    j = left.join(right, keys, "full").fillna(0.0, subset=list(weights))
    for out, (a, b) in (labels or {}).items():
        j = j.withColumn(out, F.coalesce(a, b))
    return j
