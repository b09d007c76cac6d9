"""Fixed effects of factors with any number of levels, absorbed by alternating projections.

The sweeps run on level effects, not on rows: rows are reduced once to the cells of the factors (counts and sums), each
sweep replaces the effects of one factor at a time by the cell means left over by the others, and the rows are read
a second time only to subtract the finished effects. A cell table is never larger than the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firmlens.functions.columns import all_present
from firmlens.operators import lsq
from firmlens.session import materialise


def _left_over(cells: DataFrame, keys: list[str], effects: dict[str, DataFrame], cols: list[str], value: str) -> tuple[DataFrame, list[Column]]:
    """``cells`` joined with the effects of the given factors, and each column's remainder; ``value`` names the sum of a column."""
    out = cells
    for num, (f, e) in enumerate(effects.items()):
        out = out.join(e.select(*keys, f, *[F.col(c).alias(f"_e{num}_{c}") for c in cols]), keys + [f])
    rest = []
    for c in cols:
        x = F.col(value.format(c))
        for num in range(len(effects)):
            x = x - (F.col("_n") * F.col(f"_e{num}_{c}") if value != "{}" else F.col(f"_e{num}_{c}"))
        rest.append(x)
    return out, rest


def level_effects(rows: DataFrame, keys: list[str], factors: list[str], cols: list[str], tol: float = 1e-11, max_sweeps: int = 1000) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(cells, effects): ``effects[f]`` holds (keys, f, cols), their sum over the factors is the projection on all dummies.

    A sweep sets the effects of each factor to the means its levels have left. With changes d and d' of two sweeps in a row the
    distance still to go is about d q / (1 - q), q = d / d'; sweeps end when that and d are below ``tol`` standard deviations of
    every column. Not reaching it in ``max_sweeps`` is an error. Rows with a missing factor must be gone.
    """
    cells = materialise(rows.groupBy(*keys, *factors).agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_s_{c}") for c in cols]), "cells")
    spread = materialise(rows.groupBy(*keys).agg(*[F.stddev_pop(c).alias(f"_d_{c}") for c in cols]), "spread")  # one row per design key
    effects: dict[str, DataFrame] = {}
    before = None
    for sweep in range(max_sweeps):
        old = effects.get(factors[-1])
        for f in factors:
            j, rest = _left_over(cells, keys, {g: e for g, e in effects.items() if g != f}, cols, "_s_{}")
            mean = j.groupBy(*keys, f).agg(*[(F.sum(x) / F.sum("_n")).alias(c) for c, x in zip(cols, rest)])
            # of two factors the first one's effects serve the second's alone: they stay part of its plan until the end
            effects[f] = mean if len(factors) == 2 and f == factors[0] else materialise(mean, "effects")
        if len(factors) == 1:
            return cells, effects
        if old is None:
            continue
        both = effects[factors[-1]].join(old.select(*keys, factors[-1], *[F.col(c).alias(f"_o_{c}") for c in cols]), keys + [factors[-1]])
        both = both.join(F.broadcast(spread), keys) if keys else both.crossJoin(F.broadcast(spread))
        moved = [F.when(F.col(f"_d_{c}") > 0, F.abs(F.col(c) - F.col(f"_o_{c}")) / F.col(f"_d_{c}")) for c in cols]
        change = both.agg(F.max(F.greatest(*moved, F.lit(0.0)))).first()[0] or 0.0
        rate = change / before if before else 1.0
        if change <= tol * 1e-3 or (rate < 1 and change * max(1.0, rate / (1 - rate)) <= tol):
            return cells, effects
        before = change
    raise RuntimeError(f"effects of {factors} still move by {change:.1e} standard deviations after {max_sweeps} sweeps")


def component_count(cells: DataFrame, keys: list[str], f: str, g: str) -> DataFrame:
    """(keys, parts): connected parts of the graph whose edges are the cells of two factors.

    The smallest level of ``f`` spreads over cells in turn until nothing moves: as many rounds as the longest shortest path has cells.
    """
    edges = cells.select(*keys, f, g).distinct()
    label = materialise(edges.select(*keys, f).distinct().withColumn("_part", F.col(f)), "parts")
    while True:
        near = edges.join(label, keys + [f]).groupBy(*keys, g).agg(F.min("_part").alias("_part"))
        step = edges.join(near, keys + [g]).groupBy(*keys, f).agg(F.min("_part").alias("_next"))
        moved = materialise(label.join(step, keys + [f]), "parts")
        label = moved.select(*keys, f, F.col("_next").alias("_part"))
        if moved.where("_next <> _part").isEmpty():
            return label.groupBy(*keys).agg(F.count_distinct("_part").alias("parts"))


def absorbed_rank(cells: DataFrame, keys: list[str], factors: list[str]) -> DataFrame:
    """(keys, absorbed): rank of the dummies of all factors, the intercept included.

    Exact for one and two factors (levels less connected parts); each further factor counts its levels less one, the usual upper bound.
    """
    counts = cells.groupBy(*keys).agg(*[F.count_distinct(f).alias(f"_l{k}") for k, f in enumerate(factors)])
    rank = F.col("_l0")
    for k in range(1, len(factors)):
        rank = rank + F.col(f"_l{k}") - (F.col("parts") if k == 1 else F.lit(1))
    if len(factors) > 1:
        parts = component_count(cells, keys, *factors[:2])
        counts = counts.join(parts, keys) if keys else counts.crossJoin(parts)
    return counts.select(*keys, rank.cast("int").alias("absorbed"))


def absorb(rows: DataFrame, keys: list[str], factors: list[str], cols: list[str], **options) -> tuple[DataFrame, DataFrame]:
    """``rows`` with the effects of all ``factors`` taken out of ``cols``, and (keys, absorbed), the rank that went with them.

    Factors may have any number of levels; nothing is pivoted, collected or broadcast but effects that adaptive execution finds small.
    Rows with a missing factor or value are left out.
    """
    rows = materialise(rows.filter(all_present(factors + cols)), "absorb")
    cells, effects = level_effects(rows, keys, factors, cols, **options)
    joined, rest = _left_over(rows, keys, effects, cols, "{}")
    kept = [c for c in rows.columns if c not in cols]
    return joined.select(*kept, *[x.alias(c) for c, x in zip(cols, rest)]), absorbed_rank(cells, keys, factors)


def absorbed_ols(df: DataFrame, keys: list[str], y: str, terms: list[str], factors: list[str], **options) -> DataFrame:
    """Coefficients (keys, term, estimate, std_error, n, rank, sigma) of ``y`` on ``terms`` with every factor of ``factors`` absorbed.

    ``rank`` counts the absorbed levels, so standard errors are those of the regression with all dummies. ``r2`` and ``adj_r2`` are of the full model.
    """
    design = lsq.Design([y], terms, {}, intercept=False)
    rows = design.project(lsq.complete(df, [y, *terms]), list(dict.fromkeys(keys + factors)))
    flat, absorbed = absorb(rows, keys, factors, design.values, **options)
    total = rows.filter(all_present(factors)).groupBy(*keys).agg(F.count("*").cast("double").alias("_n"), (F.var_pop("y0") * F.count("*")).alias("_t"))
    fits = lsq.fit(lsq.cross_products(flat, keys, design.values), keys, design, {"absorbed": (design.index(terms), 0)})
    facts = absorbed.join(total, keys) if keys else absorbed.crossJoin(total)
    both = fits.join(facts, keys) if keys else fits.crossJoin(facts)
    full = both.withColumns({"n": F.col("_n"), "tss": F.col("_t"), "rank": F.col("rank") + F.col("absorbed")})
    return lsq.coefficients(full, keys, design, terms).drop("spec", "dropped")
