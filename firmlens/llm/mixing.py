"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.llm.sides import free, let

PART = 16.0  # larger rates are sums of independent Poisson parts of at most this mean
TERMS = 64  # the tail of a part beyond these terms is below 1e-19, less than the spacing of the uniform numbers


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) with 52 bits from the md5 of the parts, the same in every engine and on every retry."""
    digits = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def _cut_points(rate: Column) -> Column:
    """Distribution function of Poisson(rate) at 0 .. TERMS."""
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("cuts"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["cuts"], F.array(s["c"] + p)).alias("cuts"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step)["cuts"]


def source_rates(docs: DataFrame, targets: DataFrame | None, total: int | None, source_col: str) -> DataFrame:
    """One row per source: ``source, n_docs, rate, parts, cuts``. ``rate`` is the mean number of copies of a document.

    ``targets`` (source, weight) gives the wanted shares; without it all sources weigh the same. Sources that
    ``targets`` lacks, or weighs null or less than 0, get rate 0. ``total`` is the wanted number of rows, by default as many as ``docs`` has.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if targets is None:
        weighed = sizes.withColumn("weight", F.lit(1.0))
    else:
        wanted = targets.groupBy(F.col("source").alias("_s")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        weighed = sizes.join(wanted, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        weighed = weighed.withColumn("weight", F.greatest(F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))
    rows, weights = weighed.agg(F.sum("n_docs"), F.sum("weight")).first()
    rows = (rows or 0) if total is None else total
    rate = F.lit(float(rows)) * F.col("weight") / F.lit(float(weights or 1.0)) / F.col("n_docs")
    parts = F.greatest(F.ceil(rate / PART), F.lit(1)).cast("int")
    return weighed.select("source", "n_docs", rate.alias("rate"), parts.alias("parts")).withColumn("cuts", _cut_points(F.col("rate") / F.col("parts")))


def mix_sources(
    docs: DataFrame, targets: DataFrame | None = None, total: int | None = None, seed: int = 42,
    id_col: str = "doc_id", source_col: str = "source", broadcast_sources: int = 10_000,
) -> DataFrame:
    """All columns of ``docs`` plus ``copy_no`` (from 1), ``n_copies`` and ``shuffle_key``, globally ordered by a hash.

    A document is repeated n times, n drawn from Poisson(rate of its source) by inverting the distribution function
    at a number hashed from seed and id, so the expected share of each source is its target weight. Rows
    are spread and sorted by a hash of seed, id and copy: a global shuffle that a rerun repeats exactly.

    A null source is a source of its own. A null id is hashed as an empty string. Rows with the same id and source get
    the same number of copies. Null and empty texts are documents like others. An empty table gives an empty table.
    Columns of ``docs`` with the names of the three new ones are replaced; other columns pass through.
    """
    docs = docs.drop("copy_no", "n_copies", "shuffle_key")
    name, parts, cuts = (free(c, docs.columns) for c in ("_source", "_parts", "_cuts"))
    rates = source_rates(docs, targets, total, source_col).select(F.col("source").alias(name), F.col("parts").alias(parts), F.col("cuts").alias(cuts))
    few = rates.limit(broadcast_sources + 1).count() <= broadcast_sources
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    found = docs.join(F.broadcast(rates) if few else rates, F.col(source_col).eqNullSafe(F.col(name)), "left")
    draws = F.aggregate(
        F.sequence(F.lit(1), F.coalesce(parts, F.lit(1))), F.lit(0),
        lambda n, j: n + let(uniform(F.lit(str(seed)), key, j.cast("string")), lambda u: F.size(F.filter(cuts, lambda c: c <= u))),
    )
    counted = found.withColumn("n_copies", draws).drop(name, parts, cuts).where("n_copies > 0")
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    order = F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}/order"), key, F.col("copy_no").cast("string"))), 1, 15)
    return copies.withColumn("shuffle_key", F.conv(order, 16, 10).cast("long")).orderBy("shuffle_key", id_col, "copy_no")
