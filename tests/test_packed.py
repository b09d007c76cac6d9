"""Rows packed by firm: firms cut by batches, train-side sums, predictions without a row per model."""

import os
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _rows(n=40):
    rng = np.random.default_rng(3)
    return [(s, f"f{c}", 2000 + y, int((c + y) % 3 + 1), float(rng.normal()), float(rng.normal())) for s in ("a", "b") for c in range(n) for y in range(1 + c % 5)]


def test_products_of_firms_that_batches_cut(spark):
    from firmlens.operators import lsq

    df = spark.createDataFrame(_rows(), "s string, company string, year int, fold_id int, x double, y double")
    design = lsq.Design(["y"], ["x"])
    rows = design.project(df, ["s", "company", "year", "fold_id"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = lsq.packed_products(lsq.packed_firms(rows, ["s"], design), ["s"], design, [1, 2, 3]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    own = lsq.cross_products(rows, ["s", "fold_id"], design.values).collect()
    sums = lsq.cross_products(lsq.firm_sums(rows, ["s"], design), ["s", "fold_id", "n_train"], design.values).collect()
    want = {(r.s, r.fold_id, 0, r.i, r.j): r.v for r in own} | {(r.s, r.fold_id, r.n_train, r.i, r.j): r.v for r in sums}
    have = {(r.s, r.fold_id, r.n_train, r.i, r.j): r.v for r in got}
    assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-9 for k in want)


def test_stacks_over_arrays_equal_stacks_over_rows(spark):
    from pyspark.sql import functions as F

    from firmlens.operators import stacking as ST

    rng = np.random.default_rng(5)
    wide = [(g, i, rng.normal(-1, 1, 3).tolist()) for g in ("a", "b") for i in range(60)]
    rows = spark.createDataFrame(wide, "g string, obs int, lpd array<double>")
    long = rows.select("g", "obs", F.posexplode("lpd").alias("i", "lpd_obs")).withColumn("model_key", F.concat(F.lit("m"), "i"))
    names = {"m0": 0, "m1": 1, "m2": 2}
    whole = ST.stack_arrays(rows, ["g"], ["g"], {(g,): ((g,), names) for g in "ab"}).collect()
    want = {(r.g, r.model_key): r for r in ST.stack(long, ["g"], ["obs"]).collect()}
    assert len(whole) == 6
    for r in whole:
        w = want[r.g, r.model_key]
        assert abs(r.weight - w.weight) < 1e-8 and abs(r.objective - w.objective) < 1e-8 and abs(r.singleton_elpd - w.singleton_elpd) < 1e-8
    pairs = ST.stack_arrays(rows, ["g"], ["g", "pair"], {("a", "x"): (("a",), {"m0": 0, "m2": 2})})
    assert {r.model_key for r in pairs.collect()} == {"m0", "m2"}


def test_packed_draws_equal_long_draws(spark):
    from pyspark.sql import functions as F

    from firmlens.operators import draws as D

    rng = np.random.default_rng(7)
    wide = [(i, float(rng.normal()), rng.normal(size=40).tolist(), rng.normal(size=40).tolist(), rng.normal(-1, 1, 40).tolist()) for i in range(30)]
    wide += [(30, 0.5, [1.0] * 40, [1.0] * 40, [-1.0] * 40), (31, 50.0, rng.normal(size=40).tolist(), rng.normal(size=40).tolist(), rng.normal(-1, 9, 40).tolist())]
    rows = spark.createDataFrame(wide, "obs int, ta_scaled double, epred array<double>, predict array<double>, log_lik array<double>")
    long = rows.select("obs", "ta_scaled", F.inline(F.arrays_zip("epred", "predict", "log_lik", F.sequence(F.lit(1), F.lit(40)).alias("draw_id"))))
    long = long.toDF("obs", "ta_scaled", "epred", "predict", "log_lik", "draw_id")

    def same(packed, plain):
        a, b = packed.toPandas().set_index("obs").sort_index(), plain.toPandas().set_index("obs").sort_index()
        assert len(a) == len(wide)
        for c in b.columns:
            assert a[c].tolist() == b[c].tolist() if b[c].dtype == object else np.allclose(a[c], b[c], atol=1e-9, equal_nan=True), c

    same(D.packed_summary(rows, ["obs"]), D.predictive_summary(long, ["obs"]))
    same(D.packed_kde_log_score(rows, ["obs"]), D.kde_log_score(long, ["obs"]))
    same(D.packed_importance_loo(rows, ["obs"]), D.importance_loo(long, ["obs"]))
    same(D.packed_smoothed_loo(rows, ["obs"]), D.pareto_smoothed_loo(long, ["obs"]))
