"""Regressions on top-share classes from one row per firm against the same from one row per key and firm-year."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FLAGS, CONTROLS, KEYS, OUT = ["row_only", "grouped_only", "common"], ["size", "age"], ["space", "metric", "outcome"], ["o1", "o2"]
SLOTS = [("s1", "m1"), ("s1", "m2"), ("s2", "m1")]


@pytest.fixture(scope="module")
def tables(spark):
    """(base, pairs, long): outcomes and controls with gaps, scores by slot, and their long form; the last slot has too few rows, one firm alone holds a class."""
    from pyspark.sql import functions as F

    from firmlens.operators import compare as C

    rng = np.random.default_rng(2)
    gap = lambda share: None if rng.random() < share else float(rng.normal())
    firm_years = [(f"c{c}", 2000 + y) for c in range(60) for y in range(1 + c % 5)]
    base = [(c, y, "ABC"[int(c[1:]) % 3], gap(0.1), gap(0.1), gap(0.2), gap(0.1)) for c, y in firm_years] + [("late", 2009, "A", 1.0, 1.0, None, None)]
    base = spark.createDataFrame(base, "company string, year int, industry string, size double, age double, o1 double, o2 double")
    score = lambda: None if rng.random() < 0.05 else float(abs(rng.normal()))
    pairs = spark.createDataFrame([(*s, c, y, score(), score()) for s in SLOTS for c, y in firm_years if s[0] == "s1" or y == 2000], "space string, metric string, company string, year int, a double, b double")
    cls = F.col("membership_class")
    flags = C.membership(pairs, ["space", "metric"], "a", "b", share=0.2).select("space", "metric", "company", "year", *[(cls == c).cast("double").alias(t) for c, t in (("a_only", "row_only"), ("b_only", "grouped_only"), ("both", "common"))])
    each = base.select("company", "year", "industry", *CONTROLS, F.inline(F.array(*[F.struct(F.lit(o).alias("outcome"), F.col(o).alias("y")) for o in OUT])))
    return base, pairs, flags.join(each.where("y is not null"), ["company", "year"]).cache()


def _packed(base, pairs):
    from firmlens.operators import compare as C
    from firmlens.plans import membership as M

    return M.packed_rows(base, C.packed_membership(pairs, ["space", "metric"], SLOTS, "a", "b", share=0.2))


def _same(got, want, by):
    got, want = got.toPandas().set_index(by).sort_index(), want.toPandas().set_index(by).sort_index()
    assert len(want) and got.index.equals(want.index)
    for c in want.columns:
        if want[c].dtype == float:
            assert np.allclose(got[c].astype(float), want[c], rtol=1e-7, atol=1e-9, equal_nan=True), c
        else:
            assert got[c].tolist() == want[c].tolist(), c


def test_influence_of_firms_from_packed_rows(spark, tables):
    from pyspark.sql import functions as F

    from firmlens.operators import lsq
    from firmlens.plans import membership as M
    from firmlens.plans import scoring

    base, pairs, long = tables
    usable = scoring.variation(long, KEYS).filter("not thin").select(*KEYS)
    df = lsq.complete(long.join(F.broadcast(usable), KEYS), ["y", *FLAGS, *CONTROLS])
    design = lsq.Design(["y"], FLAGS + CONTROLS, lsq.factor_levels(df, ["industry", "year"]))
    rows = design.project(df, [*KEYS, "company"])
    xs = design.index(FLAGS + CONTROLS, ["industry", "year"])
    full = lsq.coefficients(lsq.fit(lsq.cross_products(rows, KEYS, design.values), KEYS, design, {"b": (xs, 0)}), KEYS, design, FLAGS)
    want = lsq.influence_summary(lsq.leave_one_firm_out(rows, KEYS, design, xs, FLAGS), full, KEYS)
    packed = _packed(base, pairs)
    got = M.leave_one_firm_out(packed, SLOTS, OUT, FLAGS, CONTROLS, KEYS)
    _same(got.select(*want.columns), want, [*KEYS, "term"])
    # A firm's rows come once, whatever the number of keys: the former code shuffled a matrix for every key and firm.
    assert packed.count() == packed.select("company").distinct().count() < rows.select(*KEYS, "company").distinct().count()


def test_group_without_which_a_column_is_lost(spark):
    from firmlens.operators import lsq

    rng = np.random.default_rng(8)
    x = np.column_stack([np.ones(30), rng.normal(size=30), np.r_[1.0, 1.0, np.zeros(28)]])
    y, starts = rng.normal(size=30), np.arange(0, 30, 2)
    z = np.column_stack([x, y])
    got = lsq.WithoutGroups(z.T @ z, [0, 1, 2], 3, [1, 2]).coefficients(x, y, starts)
    for i, s in enumerate(starts):
        left = np.delete(np.arange(30), [s, s + 1])
        b = np.linalg.lstsq(x[left], y[left], rcond=None)[0]
        assert got[i, 0] == pytest.approx(b[1])
        assert np.isnan(got[i, 1]) if s == 0 else got[i, 1] == pytest.approx(b[2])


def test_specification_grid_from_packed_rows(spark, tables):
    from firmlens.plans import membership as M
    from firmlens.plans import scoring

    base, pairs, long = tables
    specs = {
        "plain": (["size"], ["industry", "year"], "firm", False), "none": ([], ["industry", "year"], "firm", False), "firms": (["size", "age"], ["company", "year"], "firm", False),
        "cut": (["size"], ["industry", "year"], "firm", True), "two": (["size", "age"], ["industry", "year"], "two_way", False),
    }
    sets = {s: OUT[:1] if s == "none" else OUT for s in specs}
    want = scoring.specification_grid(long, KEYS, FLAGS, specs, outcome_sets=sets)
    got = M.specification_grid(_packed(base, pairs), SLOTS, OUT, FLAGS, KEYS, specs, outcome_sets=sets)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert "insufficient_variation" in {r.se_status for r in got.collect()}
    _same(got, want, [*KEYS, "spec", "term"])
