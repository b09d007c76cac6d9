"""Distributed ranks, running totals and quantiles against numpy, under ties, hot groups and repartitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.operators import aggregates as A
from firmlens.operators import compare as C
from firmlens.operators import cv, infer
from firmlens.operators import prep
from firmlens.operators.ordered import average_ranks, complement_quantiles_long, quantiles_long, rank_rows, running


def hot(spark, n=5000, seed=1):
    """One value holds a third of all rows and one group most of them."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random(n) < 0.33, 7.0, rng.normal(size=n))
    g = np.where(rng.random(n) < 0.8, "big", "small")
    return spark.createDataFrame([(int(i), str(a), float(b)) for i, (a, b) in enumerate(zip(g, x))], "id int, g string, x double"), g, x


@pytest.mark.parametrize("accuracy", [20, 50, 100000])
def test_exact_quantiles(spark, accuracy):
    df, g, x = hot(spark)
    probs = [0.0, 0.01, 0.25, 0.5, 0.66, 0.95, 0.99, 1.0]
    for parts in (1, 7):
        for r in quantiles_long(df.repartition(parts), ["g"], probs, accuracy=accuracy).collect():
            assert r.q == pytest.approx(np.quantile(x[g == r.g], probs).tolist(), abs=1e-12)
            assert r.n == (g == r.g).sum()


def test_selection_in_many_rounds(spark):
    """A bound of a few values forces rounds; one value holds half of all rows, and a coarse sketch misses its own promise at times."""
    rng = np.random.default_rng(8)
    x = np.where(rng.random(6000) < 0.5, 0.25, np.round(rng.standard_cauchy(6000), 4))
    g = np.where(rng.random(6000) < 0.9, "big", None)
    df = spark.createDataFrame([(a, float(b)) for a, b in zip(g, x)], "g string, x double").repartition(6)
    probs = [0.0, 0.1, 0.25, 0.5, 0.997, 1.0]
    for accuracy, bound in ((10, 3), (10000, 1)):
        for r in quantiles_long(df, ["g"], probs, accuracy=accuracy, bound=bound).collect():
            part = x[g == r.g] if r.g else x[g == None]  # noqa: E711
            assert r.n == len(part) and r.q == pytest.approx(np.quantile(part, probs).tolist(), abs=1e-12)


def test_quantiles_of_few_rows(spark):
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = spark.createDataFrame([(n, float(k * k)) for n in range(1, 8) for k in range(n)], "n_rows int, x double")
    got = {r.n_rows: (r.n, r.q) for r in quantiles_long(df, ["n_rows"], probs).collect()}
    assert got == {n: (n, pytest.approx(np.quantile([float(k * k) for k in range(n)], probs).tolist())) for n in range(1, 8)}


@pytest.mark.parametrize("accuracy, bound", [(10000, 1 << 15), (20, 4)])
def test_quantiles_of_training_parts(spark, accuracy, bound):
    rng = np.random.default_rng(6)
    n = 1500
    g, f = np.where(rng.random(n) < 0.8, "a", "b"), rng.integers(1, 4, n)
    x = np.where(rng.random(n) < 0.4, 2.0, np.round(rng.normal(size=n), 3))
    df = spark.createDataFrame([(str(a), int(b), float(c)) for a, b, c in zip(g, f, x)] + [("c", 1, 5.0), ("a", 2, None)], "g string, fold_id int, x double")
    probs = [0.0, 0.01, 0.5, 0.9, 1.0]
    got = {(r.g, r.fold): (r.n, r.q) for r in complement_quantiles_long(df, ["g"], "fold_id", [1, 2, 3], probs, accuracy=accuracy, bound=bound).collect()}
    want = {(a, k): x[(g == a) & (f != k)] for a in "ab" for k in (1, 2, 3)} | {("c", 2): [5.0], ("c", 3): [5.0]}
    assert got.keys() == want.keys()
    for key, part in want.items():
        assert got[key][0] == len(part) and got[key][1] == pytest.approx(np.quantile(part, probs).tolist(), abs=1e-12)


def test_fold_local_matches_copies_of_the_rows(spark):
    rng = np.random.default_rng(7)
    n = 400
    rows = [(f"s{i % 2}", i, int(rng.integers(1, 5)), float(rng.normal()), float(rng.exponential())) for i in range(n)]
    df = spark.createDataFrame(rows, "sample string, id int, fold_id int, u double, v double")
    got = {(r["sample"], r.id, r.fold): (r.part, r.u, r.v) for r in prep.fold_local(df, ["sample"], ["u", "v"], 4).collect()}
    assert len(got) == 4 * n
    for s in ("s0", "s1"):
        part = [r for r in rows if r[0] == s]
        for k in range(1, 5):
            for c in (3, 4):
                train = np.array([r[c] for r in part if r[2] != k])
                lo, hi = np.quantile(train, [0.01, 0.99])
                m, sd = np.clip(train, lo, hi).mean(), np.clip(train, lo, hi).std(ddof=1)
                for r in part:
                    assert got[s, r[1], k][c - 2] == pytest.approx((np.clip(r[c], lo, hi) - m) / sd, abs=1e-9)
                    assert got[s, r[1], k][0] == ("test" if r[2] == k else "train")


def test_no_window_sorts_a_group(spark):
    df, _, _ = hot(spark, 100)
    for frame in (quantiles_long(df, ["g"], [0.5]), average_ranks(df, ["g"], "x", "r")):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window" in line]
        assert all("_block" in line or "_eb" in line for line in windows), windows
    assert "Window" not in quantiles_long(df, ["g"], [0.5])._jdf.queryExecution().optimizedPlan().toString()


def test_average_ranks_over_block_edges(spark):
    """Ties that begin in one block of the sort, fill others and end in a third."""
    import pandas as pd

    rng = np.random.default_rng(4)
    x = np.r_[np.full(3000, 5.0), rng.integers(0, 10, 2000).astype(float), np.full(500, 9.5)]
    g = np.where(rng.random(len(x)) < 0.7, "a", "b")
    df = spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(g, x))], "id int, g string, x double")
    got = average_ranks(df.repartition(12), ["g"], "x", "r").toPandas().sort_values("id")
    assert np.allclose(got.r.to_numpy(), pd.Series(x).groupby(g).rank().to_numpy())
    both = rank_rows(df, ["g"], [F.desc("x"), F.col("id")], tied="x").toPandas().sort_values("id")
    assert np.allclose(both.average_rank.to_numpy(), pd.Series(-x).groupby(g).rank().to_numpy())


def test_quantiles_drop_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    r = quantiles_long(df, [], [0.5]).first()
    assert (r.n, r.q) == (2, [2.0])


def test_rank_and_running(spark):
    df, g, x = hot(spark, 3000)
    out = rank_rows(df.repartition(9), ["g"], [F.desc("x"), F.col("id")]).toPandas()
    for name in ("big", "small"):
        part = out[out.g == name].sort_values("rank")
        order = sorted(zip(-x[g == name], np.flatnonzero(g == name)))
        assert part.id.tolist() == [int(i) for _, i in order]
        assert part["rank"].tolist() == list(range(1, len(part) + 1))
    run = running(df, ["g"], [F.col("id")], {"cum": ("sum", "x"), "ex": ("sum_before", "x"), "low": ("min_after", "x")}).toPandas()
    for name in ("big", "small"):
        part = run[run.g == name].sort_values("id")
        v = x[g == name]
        assert np.allclose(part["cum"], np.cumsum(v)) and np.allclose(part["ex"], np.cumsum(v) - v)
        assert np.allclose(part["low"], np.minimum.accumulate(v[::-1])[::-1])


def test_average_ranks_and_spearman(spark):
    import pandas as pd

    df, g, x = hot(spark, 2000)
    got = average_ranks(df, ["g"], "x", "r").toPandas().sort_values("id")
    ref = pd.Series(x).groupby(g).rank()
    assert np.allclose(got.r.to_numpy(), ref.to_numpy())
    y = np.round(x + np.random.default_rng(2).normal(size=len(x)), 1)
    d2 = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    want = np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]
    assert A.spearman(d2, [], "x", "y").first().spearman == pytest.approx(want)


def test_ks_statistic(spark):
    rng = np.random.default_rng(3)
    a, b = np.round(rng.normal(size=400), 1), np.round(rng.normal(0.4, 1, 300), 1)
    df = spark.createDataFrame([(float(v), True) for v in a] + [(float(v), False) for v in b], "x double, side boolean")
    grid = np.unique(np.r_[a, b])
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert A.ks_statistic(df, [], "x", "side").first().ks_d == pytest.approx(want)


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.20, None, 0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p double")
    got = {r.id: r.q_value for r in infer.benjamini_hochberg(df, [], "p", ["id"]).collect()}
    assert got[4] is None
    assert [got[i] for i in (0, 2, 1, 3, 5)] == pytest.approx([0.05, 0.04 * 5 / 3, 0.04 * 5 / 3, 0.25, 0.5])


def test_folds(spark):
    rows = [(f"c{i}", "hot" if i % 3 else "cold", 2016 + y) for i in range(90) for y in range(1 + i % 6)]
    df = spark.createDataFrame(rows, "company string, industry string, year int")
    g = cv.grouped_folds(df, 5)
    again = cv.grouped_folds(df.repartition(11), 5)
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, again.collect()))
    sizes = g.groupBy("industry", "fold_id").count().toPandas()
    assert (sizes.groupby("industry")["count"].max() - sizes.groupby("industry")["count"].min() <= 1).all()
    r = cv.row_folds(df, 5)
    multi = r.groupBy("company").agg(F.count("*").alias("n"), F.count_distinct("fold_id").alias("k")).toPandas()
    assert (multi.k == multi.n.clip(upper=5)).all()
    assert cv.split_firms(df.join(g.drop("industry"), "company"), []).count() == 0
    flags = cv.history_flags(r, []).toPandas()
    assert (flags.same_firm_history_available == (flags.groupby("company").year.transform("size") > 1)).all()


def test_level_coverage(spark):
    s = "industry string, year int"
    train = spark.createDataFrame([("A", 2016), ("B", 2017), ("A", 2018)], s)
    cv.assert_levels_covered(train, spark.createDataFrame([("B", 2016)], s), ["industry", "year"])
    with pytest.raises(ValueError, match="industry"):
        cv.assert_levels_covered(train, spark.createDataFrame([("C", 2017)], s), ["industry", "year"])
    with pytest.raises(ValueError, match="year"):
        cv.assert_levels_covered(train, spark.createDataFrame([("A", 2019)], s), ["industry", "year"])


@pytest.mark.parametrize("n", [1, 20, 21, 200])
def test_matched_comparison_all_tied(spark, n):
    df = spark.createDataFrame([("k", f"c{i:03d}", 2016, 1.0, 1.0) for i in range(n)] + [("k", "bad", 2016, float("nan"), 1.0)], "k string, company string, year int, a double, b double")
    r = C.invariants(C.matched_comparison(df, ["k"], "a", "b")).first()
    top = max(1, int(np.ceil(0.05 * n)))
    assert (r.n_joined, r.top_n, r.intersection_n, r.jaccard, r.invariants_hold) == (n, top, top, 1.0, True)
    assert r.cutoff_tie_count_a == n


def test_baseline_comparison(spark):
    s = "target_space string, metric string, jaccard double"
    keys = [("ex_post", "raw"), ("ex_post", "z"), ("real_time", "raw"), ("real_time", "z")]
    base = spark.createDataFrame([(*k, v) for k, v in zip(keys, (0.42, 0.55, 0.70, 0.76))], s)
    var = spark.createDataFrame([(*k, v) for k, v in zip(keys, (0.45, 0.70, 0.77, 0.95))], s)
    got = {(r.target_space, r.metric): (round(r.difference, 2), r.decision) for r in C.compare_with_baseline(var, base).collect()}
    assert [got[k] for k in keys] == [(0.03, "PASS"), (0.15, "WARN"), (0.07, "PASS"), (0.19, "FAIL")]
    with pytest.raises(ValueError, match="no baseline"):
        C.compare_with_baseline(var, base.limit(3))
