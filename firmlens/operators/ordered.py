"""Exact ranks, running totals and quantiles that never gather a group in one task.

A plain window over a whole sample sorts it in a single task. Here one range-partitioned sort places
the rows, a tiny per-partition total table supplies the offsets, and everything else stays local.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firmlens.functions.columns import missing
from firmlens.session import materialise

_POS = "_pos"
_BLOCK = "_block"


def _placed(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Globally sorted rows carrying (block, position); written once so that all readers agree."""
    spread = df.orderBy(*[F.col(k) for k in keys], *order).withColumn(_POS, F.monotonically_increasing_id())
    return materialise(spread, "sorted").withColumn(_BLOCK, F.shiftright(F.col(_POS), 33))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def _join_blocks(rows: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    on = keys + [_BLOCK]
    renamed = blocks.select(*[F.col(c).alias(f"_b_{c}") if c in on else F.col(c) for c in blocks.columns])
    cond = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(renamed[f"_b_{c}"]) for c in on])
    return rows.join(renamed, cond, "left").drop(*[f"_b_{c}" for c in on])


def rank_rows(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank", tied: str | None = None, average: str = "average_rank") -> DataFrame:
    """``row_number`` over (keys, order). ``order`` must be total for a deterministic answer.

    With ``tied``, the column that ``order`` begins with, also ``average``: the mean rank of the rows that share its value. A
    value's rows may fill many blocks of the sort; counts of the first and last value of each block carry them over its edges.
    """
    rows = _placed(df, keys, order)
    before = W.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    if tied is None:
        blocks = rows.groupBy(*keys, _BLOCK).agg(F.min(_POS).alias("_first"), F.count("*").alias("_n"))
        joined = _join_blocks(rows, blocks.select(*keys, _BLOCK, "_first", offset), keys)
    else:
        runs = rows.groupBy(*keys, _BLOCK, F.col(tied).alias("_v")).agg(F.min(_POS).alias("_s"), F.count("*").alias("_c"))
        ends = runs.groupBy(*keys, _BLOCK).agg(
            F.min("_s").alias("_first"), F.sum("_c").alias("_n"), F.min_by("_v", "_s").alias("_v0"), F.min_by("_c", "_s").alias("_c0"), F.max_by("_v", "_s").alias("_v1"), F.max_by("_c", "_s").alias("_c1"),
        ).select("*", offset)
        # One row per block: a value on both its edges fills it. Equal edge values lie in neighbouring blocks.
        parts = F.array(F.struct(F.col("_v0").alias("_v"), F.col("_c0").alias("_c")), F.struct(F.col("_v1").alias("_v"), F.col("_c1").alias("_c")))
        edges = ends.select(*keys, _BLOCK, F.inline(F.when(F.col("_v0").eqNullSafe(F.col("_v1")), F.slice(parts, 1, 1)).otherwise(parts)))
        same = W.partitionBy(*keys, "_v").orderBy(_BLOCK)
        edges = edges.select(
            *keys, F.col(_BLOCK).alias("_eb"), "_v", F.coalesce(F.sum("_c").over(same.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"),
            F.coalesce(F.sum("_c").over(same.rowsBetween(1, W.unboundedFollowing)), F.lit(0)).alias("_later"),
        )
        carried = edges.groupBy(*keys, F.col("_eb").alias(_BLOCK)).agg(F.max("_earlier").alias("_earlier"), F.max("_later").alias("_later"))
        blocks = _join_blocks(ends.select(*keys, _BLOCK, "_first", "_offset", "_v0", "_v1"), carried, keys)
        run = W.partitionBy(*keys, _BLOCK, tied)  # rows of one value in one block
        joined = _join_blocks(rows.select("*", F.min(_POS).over(run).alias("_r0"), F.max(_POS).over(run).alias("_r1")), blocks, keys)
    rank = F.col("_offset") + (F.col(_POS) - F.col("_first")) + F.lit(1)
    ranked = joined.withColumn(out, rank.cast("long"))
    if tied is not None:
        early = F.when(F.col(tied).eqNullSafe(F.col("_v0")), F.col("_earlier")).otherwise(F.lit(0))
        late = F.when(F.col(tied).eqNullSafe(F.col("_v1")), F.col("_later")).otherwise(F.lit(0))
        middle = F.col("_offset") - F.col("_first") + 1 + (F.col("_r0") - early + F.col("_r1") + late) / 2
        ranked = ranked.withColumn(average, middle).drop("_v0", "_v1", "_earlier", "_later", "_r0", "_r1")
    return ranked.drop(_POS, _BLOCK, "_first", "_offset")


def running(df: DataFrame, keys: list[str], order: list[Column], totals: dict[str, tuple[str, str]]) -> DataFrame:
    """Running aggregates. ``totals`` maps output name to (kind, column).

    Kinds: ``sum`` (inclusive running sum), ``sum_before`` (exclusive), ``min_after`` (minimum of this
    and all later rows).
    """
    rows = _placed(df, keys, order)
    aggs, offsets = [], []
    wb = W.partitionBy(*keys).orderBy(_BLOCK)
    wb_back = W.partitionBy(*keys).orderBy(F.desc(_BLOCK))
    for name, (kind, col) in totals.items():
        fn = F.min if kind == "min_after" else F.sum
        aggs.append(fn(col).alias(f"_t_{name}"))
        if kind == "min_after":
            offsets.append(F.min(f"_t_{name}").over(wb_back.rowsBetween(W.unboundedPreceding, -1)).alias(f"_o_{name}"))
        else:
            prior = F.sum(f"_t_{name}").over(wb.rowsBetween(W.unboundedPreceding, -1))
            offsets.append(F.coalesce(prior, F.lit(0)).alias(f"_o_{name}"))
    blocks = rows.groupBy(*keys, _BLOCK).agg(*aggs).select(*keys, _BLOCK, *offsets)
    # Growing frames cost one step per row; a shrinking frame (current row to the end) would be redone
    # for every row, so the backward minimum runs over the reversed order instead.
    wl = W.partitionBy(*keys, _BLOCK).orderBy(_POS)
    wl_back = W.partitionBy(*keys, _BLOCK).orderBy(F.desc(_POS))
    local = []
    for name, (kind, col) in totals.items():
        if kind == "min_after":
            local.append(F.min(col).over(wl_back.rowsBetween(W.unboundedPreceding, 0)).alias(f"_l_{name}"))
        else:
            local.append(F.sum(col).over(wl.rowsBetween(W.unboundedPreceding, 0)).alias(f"_l_{name}"))
    joined = _join_blocks(rows.select("*", *local), blocks, keys)
    for name, (kind, col) in totals.items():
        here, far = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        value = F.least(here, far) if kind == "min_after" else here + far
        joined = joined.withColumn(name, value - F.col(col) if kind == "sum_before" else value)
    drop = [f"_{p}_{n}" for n in totals for p in ("l", "o")]
    return joined.drop(_POS, _BLOCK, *drop)


def average_ranks(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Ascending rank with ties averaged, from one sorted scan: equal values are dealt over its blocks by row number."""
    spread = df.withColumn("_deal", F.monotonically_increasing_id())
    return rank_rows(spread, keys, [F.col(col), F.col("_deal")], "_place", col, out).drop("_deal", "_place")


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name: str = "variable", value: str = "x") -> DataFrame:
    """Long form (keys, variable, x) computed inside the scan stage."""
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(keys, cols, name, value)


MARGIN = 2  # pivots lie this many errors of the sketch on both sides of a wanted fraction
FAN = 64  # pivots of a further round
BOUND = 1 << 15  # distinct values of one interval that are put in order in one row


def _celled(values: DataFrame, pivots: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``values`` joined with ``pivots`` (keys, _p: ``n`` rising values), with ``_cell``: pivots below plus pivots not above, which rises with the value."""
    flat = pivots.selectExpr("*", *[f"get(_p, {j}) AS _p{j}" for j in range(n)])
    passed = " + ".join(f"CAST(_x > _p{j} AS INT) + CAST(_x >= _p{j} AS INT)" for j in range(n))
    return _on(values, flat, keys).withColumn("_cell", F.expr(passed)).drop(*[f"_p{j}" for j in range(n)])


def _pivot(cell: Column) -> Column:
    """The pivot that a cell lies on, or null for a cell between two: an even cell is on a pivot that occurs more than once, or on none."""
    j = F.shiftright(cell, 1)
    again = (j > 0) & (F.get("_p", j - 1) == F.get("_p", j))
    return F.when((cell % 2 == 1) | again, F.get("_p", j))


def _locate(counts: Column, k: Column) -> Column:
    """(cell, before, rows, values): where the k-th row falls in sorted (cell, rows, values) and how many rows come before that cell."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast(_SPOT).alias("spot"))

    def step(s: Column, c: Column) -> Column:
        here = F.struct(c["_cell"].alias("cell"), s["seen"].alias("before"), c["_c"].alias("rows"), c["_d"].alias("values"))
        return F.struct((s["seen"] + c["_c"]).alias("seen"), F.when(s["spot"].isNull() & (k <= s["seen"] + c["_c"]), here).otherwise(s["spot"]).alias("spot"))

    return F.aggregate(counts, start, step)["spot"]


_SPOT = "struct<cell:int,before:bigint,rows:bigint,values:bigint>"


def _nth(values: Column, k: Column) -> Column:
    """The k-th row of sorted (value, rows)."""
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("x"))
    step = lambda s, v: F.struct((s["seen"] + v["_c"]).alias("seen"), F.when(s["x"].isNull() & (k <= s["seen"] + v["_c"]), v["_x"]).otherwise(s["x"]).alias("x"))
    return F.aggregate(values, start, step)["x"]


def _on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on null-safe keys; the size of the written right side decides how."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    renamed = right.select(*[F.col(k).alias(f"_k_{k}") if k in keys else F.col(k) for k in right.columns])
    return left.join(renamed, reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])).drop(*[f"_k_{k}" for k in keys])


def _in_order(values: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    lists = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_x", "_c"))).alias("_v"))
    return _on(asked, lists, keys).select(*asked.drop("_before").columns, _nth(F.col("_v"), F.col("_k") - F.col("_before")).alias("_q"))


def select_ranks(values: DataFrame, asked: DataFrame, keys: list[str], bound: int = BOUND) -> DataFrame:
    """(keys, _k, _q): the ``_k``-th smallest row of each group of ``values`` (keys, _x, _c rows with that value).

    Rounds cut every group at ``FAN`` pivots and keep the interval that holds the wanted row, known by counts, so that its number of distinct values falls
    by that factor whatever the pivots are; a pivot that is the wanted value ends the search. Groups with at most ``bound`` distinct values are put in order
    in one row; no other group ever is.
    """
    found = None
    level = 0
    while True:
        sizes = values.groupBy(*keys).agg(F.count("*").alias("_d"))
        over = materialise(sizes.where(F.col("_d") > bound).drop("_d"), "wide")
        done = _in_order(_anti(values, over, keys), _anti(asked, over, keys), keys)
        found = done if found is None else found.unionByName(done.select(*found.columns))
        if over.isEmpty():
            return found
        wide, wanted = _on(values, over, keys), _on(asked, over, keys)
        cuts = [(j + 1) / (FAN + 1) for j in range(FAN)]
        pivots = materialise(wide.groupBy(*keys).agg(F.percentile_approx("_x", cuts, 40 * FAN).alias("_p")), "pivots")
        celled = materialise(_celled(wide, pivots, keys, FAN).select(*keys, "_cell", "_x", "_c"), "cells")
        counts = celled.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_c"), F.count("*").alias("_d"))
        counts = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_cell", "_c", "_d"))).alias("_counts"))
        spots = _on(_on(wanted, counts, keys), pivots, keys).withColumn("_spot", _locate(F.col("_counts"), F.col("_k") - F.col("_before")))
        spots = materialise(spots.withColumn("_hit", _pivot(F.col("_spot.cell"))).drop("_p", "_counts"), "spots")
        found = found.unionByName(spots.where("_hit IS NOT NULL").withColumn("_q", F.col("_hit")).select(*found.columns))
        # The interval becomes part of the group; earlier intervals are only carried along.
        name = f"_cell{level}"
        asked = spots.where("_hit IS NULL").select(*asked.drop("_before").columns, (F.col("_before") + F.col("_spot.before")).alias("_before"), F.col("_spot.cell").alias(name))
        found = found.withColumn(name, F.lit(None).cast("int"))
        keys = [*keys, name]
        values = _on(celled.withColumnRenamed("_cell", name), materialise(asked.select(*keys).distinct(), "open"), keys)
        level += 1


def _anti(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return df if gone.isEmpty() else df.limit(0)
    renamed = gone.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    return df.join(renamed, reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]), "left_anti")


def quantiles_long(df: DataFrame, keys: list[str], probs: list[float], value: str = "x", accuracy: int = 10000, bound: int = BOUND) -> DataFrame:
    """Exact type-7 quantiles of ``value`` per ``keys``: rows (keys, n, q array aligned with ``probs``).

    Multi-rank selection. Pass 1 sketches pivots around every wanted fraction. Pass 2 counts the rows on and between pivots and keeps, with their
    counts, only the values of intervals in which a wanted row may fall; all others collapse before the shuffle. The counts then say exactly which interval each row lies
    in, whatever the sketch's error; an interval that was not kept is read again. What is left of a wide group is narrowed in further rounds
    (:func:`select_ranks`). One path serves groups of all sizes, ties included, and no group is sorted in one task.
    """
    data = df.filter(~missing(value)).select(*keys, F.col(value).cast("double").alias("_x"))
    at = _fractions(probs, accuracy)
    sketch = materialise(data.groupBy(*keys).agg(F.count("*").alias("_n"), F.percentile_approx("_x", at, accuracy).alias("_p")), "pivots")
    sketch = _prefetched(sketch, probs, at, accuracy)
    hist = _histogram(data, sketch, keys, [], len(at))
    return _from_counts(hist, sketch, keys, probs, lambda missed: _on(data, missed, keys).withColumn("_c", F.lit(1).cast("long")), bound)


def complement_quantiles_long(df: DataFrame, keys: list[str], fold: str, folds: list[int], probs: list[float], value: str = "x", accuracy: int = 10000, bound: int = BOUND) -> DataFrame:
    """Exact quantiles of the training part of every fold: rows (keys, fold, n, q) over the rows of all other folds.

    No row is copied. One pass sketches the pivots of all complements side by side, one counts rows by own fold and interval; the counts of a training part
    are those of all folds less its own, and only the few values kept near the wanted ranks are repeated for the folds.
    """
    data = df.filter(~missing(value)).select(*keys, F.col(fold).alias("_own"), F.col(value).cast("double").alias("_x"))
    at = _fractions(probs, accuracy)
    parts = [F.percentile_approx(F.when(~F.col("_own").eqNullSafe(F.lit(k)), F.col("_x")), at, accuracy).alias(f"_p{k}") for k in folds]
    sizes = [F.count_if(~F.col("_own").eqNullSafe(F.lit(k))).alias(f"_n{k}") for k in folds]
    wide = materialise(data.groupBy(*keys).agg(*sizes, *parts), "pivots")
    each = wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"_n{k}").alias("_n"), F.col(f"_p{k}").alias("_p")) for k in folds])))
    each = _prefetched(each.where("_n > 0"), probs, at, accuracy)
    m = len(at)
    # All complements share one set of pivots; a kept interval of one of them covers several of the shared ones.
    joint = wide.select(*keys, F.array_sort(F.array_distinct(F.flatten(F.array(*[F.coalesce(f"_p{k}", F.array().cast("array<double>")) for k in folds])))).alias("_p"))
    spans = each.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.lit(m)), lambda j: F.struct(F.get("_kept", j).alias("keep"), F.when(j > 0, F.get("_p", j - 1)).alias("lo"), F.get("_p", j).alias("hi"))))).where("keep")
    spans = spans.groupBy(*keys).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    joint = _on(joint, spans, keys)
    size = F.size("_p")
    lo = lambda j: F.when(j > 0, F.get("_p", j - 1))
    inside = lambda j: F.exists("_spans", lambda s: (s["lo"].isNull() | (lo(j) >= s["lo"])) & (s["hi"].isNull() | (F.get("_p", j) <= s["hi"])))
    # Shorter sets end in NaN, which no value exceeds.
    joint = materialise(joint.select(*keys, F.concat("_p", F.array_repeat(F.lit(float("nan")), F.lit(m * len(folds)) - size)).alias("_p"), F.transform(F.sequence(F.lit(0), size), inside).alias("_kept")), "joint")
    hist = _histogram(data, joint, keys, ["_own"], m * len(folds))
    every = df.sparkSession.createDataFrame([(k,) for k in folds], "fold int")  # the folds of the design
    counts = hist.crossJoin(F.broadcast(every)).where("NOT (_own <=> fold)").groupBy(*keys, "fold", "_cell", "_x").agg(F.sum("_c").alias("_c"))
    shared = _on(each.select(*keys, "fold", "_n"), joint, keys)
    again = lambda missed: _on(data.crossJoin(F.broadcast(every)).where("NOT (_own <=> fold)"), missed, [*keys, "fold"]).withColumn("_c", F.lit(1).cast("long"))
    return _from_counts(materialise(counts, "complements"), shared, [*keys, "fold"], probs, again, bound)


def _fractions(probs: list[float], accuracy: int) -> list[float]:
    return sorted({min(1.0, max(0.0, p + side * MARGIN / accuracy)) for p in probs for side in (-1, 1)})


def _wants(probs: list[float]) -> Column:
    return F.expr(f"array({', '.join(f'{float(p)!r}D' for p in probs)})")


def _lower_rank(p: Column) -> Column:
    return F.floor((F.col("_n") - 1) * p) + 1


def _prefetched(sketch: DataFrame, probs: list[float], at: list[float], accuracy: int) -> DataFrame:
    """``sketch`` (keys, _n, _p) with ``_kept``: whether a wanted row may lie between the pivots j - 1 and j by the sketch's promise, give or take a row."""
    n, wants, unit = F.col("_n"), _wants(probs), 1.0 / accuracy
    edges = F.expr(f"array({', '.join(f'{a!r}D' for a in (-1.0, *at, 2.0))})")
    near = lambda j: F.exists(wants, lambda p: (_lower_rank(p) + 1 >= (F.get(edges, j) - unit) * n - 1) & (_lower_rank(p) <= (F.get(edges, j + 1) + unit) * n + 2))
    apart = lambda j: ~F.coalesce((j > 0) & (F.get("_p", j - 1) == F.get("_p", j)), F.lit(False))
    return sketch.withColumn("_kept", F.transform(F.sequence(F.lit(0), F.lit(len(at))), lambda j: near(j) & apart(j)))


def _histogram(data: DataFrame, pivots: DataFrame, keys: list[str], extra: list[str], n: int) -> DataFrame:
    """(keys, extra, _cell, _x, _c): rows by cell, and by value where the interval is kept."""
    cell = F.col("_cell")
    stays = (cell % 2 == 0) & F.coalesce(F.get("_kept", F.shiftright(cell, 1)), F.lit(False))
    counted = _celled(data, pivots, keys, n).select(*keys, *extra, cell, F.when(stays, F.col("_x")).alias("_x"))
    return materialise(counted.groupBy(*keys, *extra, "_cell", "_x").agg(F.count("*").alias("_c")), "histogram")


def _from_counts(hist: DataFrame, sketch: DataFrame, keys: list[str], probs: list[float], again: Callable[[DataFrame], DataFrame], bound: int) -> DataFrame:
    """Quantiles from ``hist`` (keys, _cell, _x, _c) and ``sketch`` (keys, _n, _p); ``again`` joins the data with intervals that were not kept."""
    n, wants = F.col("_n"), _wants(probs)
    counts = hist.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_c"), F.count("_x").alias("_d"))
    counts = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_cell", "_c", "_d"))).alias("_counts"))
    each = F.transform(F.sequence(F.lit(0), F.lit(2 * len(probs) - 1)), lambda c: F.struct(
        F.shiftright(c, 1).alias("_i"), (c % 2).alias("_t"), F.least(_lower_rank(F.get(wants, F.shiftright(c, 1))) + c % 2, n).cast("long").alias("_k")))
    wanted = _on(sketch, counts, keys).select(*keys, "_n", "_p", "_counts", F.inline(each))
    spots = wanted.select(*keys, "_n", "_p", "_i", "_t", "_k", F.inline(F.array(_locate(F.col("_counts"), F.col("_k")))))
    j = F.shiftright("cell", 1)
    spots = spots.select(
        *keys, "_n", "_i", "_t", "_k", F.col("cell").alias("_cell"), F.col("before").alias("_before"), F.col("values").alias("_d"), _pivot(F.col("cell")).alias("_hit"),
        F.when(j > 0, F.get("_p", j - 1)).alias("_lo"), F.get("_p", j).alias("_hi"),
    )
    told = spots.agg(F.max("_d"), F.count_if(F.col("_hit").isNull() & (F.col("_d") == 0))).first()
    inside = hist.where("_x IS NOT NULL").withColumnRenamed("_cell", "_part")
    if told[1]:  # the sketch was further off than it promises
        missed = materialise(spots.where("_hit IS NULL AND _d = 0").select(*keys, F.col("_cell").alias("_part"), "_lo", "_hi").distinct(), "missed")
        found = again(missed).where("(_lo IS NULL OR _x > _lo) AND (_hi IS NULL OR isnan(_hi) OR _x < _hi)")
        inside = inside.unionByName(found.groupBy(*keys, "_part", "_x").agg(F.sum("_c").alias("_c")))
    asked = spots.where("_hit IS NULL").select(*keys, F.col("_cell").alias("_part"), "_i", "_t", "_k", "_before")
    in_cell = [*keys, "_part"]
    narrow = not told[1] and (told[0] or 0) <= bound
    picked = (_in_order(inside, asked, in_cell) if narrow else select_ranks(inside, asked, in_cell, bound)).select(*keys, "_i", "_t", "_q")
    ends = spots.where("_hit IS NOT NULL").select(*keys, "_i", "_t", F.col("_hit").alias("_q")).unionByName(picked)
    wide = ends.groupBy(*keys).agg(*[F.expr(f"max(CASE WHEN _i = {i} AND _t = {t} THEN _q END) AS _{'ab'[t]}{i}") for i in range(len(probs)) for t in (0, 1)])
    frac = [f"((_n - 1) * {float(p)!r}D - floor((_n - 1) * {float(p)!r}D))" for p in probs]
    q = ", ".join(f"_a{i} + {f} * (_b{i} - _a{i})" for i, f in enumerate(frac))
    return _on(wide, sketch.select(*keys, "_n"), keys).select(*keys, F.col("_n").alias("n"), F.expr(f"array({q})").alias("q"))


def complement_quantiles(df: DataFrame, keys: list[str], cols: list[str], fold: str, folds: list[int], probs: list[float]) -> DataFrame:
    """Training quantiles of several columns and all folds at once: rows (keys, variable, fold, n, q)."""
    return complement_quantiles_long(unpivot(df, [*keys, fold], cols), [*keys, "variable"], fold, folds, probs)


def quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles of several columns at once: rows (keys, variable, n, q)."""
    return quantiles_long(unpivot(df, keys, cols), keys + ["variable"], probs)
