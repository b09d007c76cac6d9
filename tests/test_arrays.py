"""Exact quantiles and moments of array places, and what rests on them."""

import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _read(width):
    def read(batch):
        yield batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)

    return read


@pytest.mark.parametrize("bound", [4, 1 << 15])
def test_quantiles_of_arrays_are_exact(spark, bound):
    from firmlens.operators import arrays as A

    rng = np.random.default_rng(11)
    n = 3000
    m = np.column_stack([
        rng.normal(size=n), np.round(rng.normal(size=n), 1), rng.normal(size=n) ** 9, np.zeros(n), np.where(rng.random(n) < 0.7, 0.0, rng.normal(size=n) * 1e-12),
        1e8 + rng.normal(size=n) * 1e-7, np.where(rng.random(n) < 0.5, np.nan, rng.normal(size=n)), np.full(n, np.nan), np.r_[1e9, rng.normal(size=n - 1)], np.r_[5.0, np.full(n - 1, np.nan)],
    ])
    df = spark.createDataFrame([(r.tolist(),) for r in m], "v array<double>").repartition(5)
    probs = [0.0, 0.01, 0.5, 0.99, 1.0]
    st = A.array_stats(df, _read(m.shape[1]), m.shape[1], lambda x: np.array([len(x)]), 1)
    got = A.array_quantiles(df, _read(m.shape[1]), st, probs, bound)
    assert st.counts.tolist() == [n] and st.n.tolist() == (~np.isnan(m)).sum(axis=0).tolist()
    for c in range(m.shape[1]):
        x = m[:, c][~np.isnan(m[:, c])]
        if len(x) == 0:
            assert np.isnan(got[c]).all()
            continue
        assert np.allclose(got[c], np.quantile(x, probs), rtol=1e-12, atol=0), c
        assert st.mean[c] == pytest.approx(x.mean(), rel=1e-9, abs=1e-12)
        if len(x) > 1:
            assert st.sd[c] == pytest.approx(x.std(ddof=1), rel=1e-6, abs=1e-12)


def test_predictive_check_of_matrices_equals_rows(spark):
    from pyspark.sql import functions as F

    from firmlens.operators import draws as D

    rng = np.random.default_rng(4)
    n, draws, models = 200, 20, ["a", "b"]
    x = rng.normal(size=(n, 2, draws)) * [[[1.0], [3.0]]]
    x[:7, 1] = np.nan  # a fold without a spread has no draws
    y = rng.normal(size=n)
    flat = spark.createDataFrame([(i, np.append(x[i].ravel(), y[i]).tolist()) for i in range(n)], "obs int, v array<double>").repartition(3)
    got = D.array_predictive_check(flat, _read(2 * draws + 1), ["model_key"], [(m,) for m in models], draws).toPandas().set_index("model_key")
    long = spark.createDataFrame([(m, i, d, float(y[i]), None if np.isnan(x[i, j, d]) else float(x[i, j, d])) for j, m in enumerate(models) for i in range(n) for d in range(draws)], "model_key string, obs int, draw_id int, ta_scaled double, predict double")
    iv = D.predictive_summary(long.withColumn("epred", F.col("predict")), ["model_key", "obs"]).fillna({"nda_q010": -np.inf, "nda_q025": -np.inf, "nda_q975": np.inf, "nda_q990": np.inf})
    want = D.predictive_check(iv.select("model_key", "obs", "ta_scaled"), long.select("model_key", "draw_id", "predict"), iv, ["model_key"]).toPandas().set_index("model_key")
    for m in models:
        for c in want.columns:
            assert got.loc[m, c] == (want.loc[m, c] if isinstance(want.loc[m, c], str) else pytest.approx(want.loc[m, c], rel=1e-9)), (m, c)


def test_the_query_makes_no_row_of_a_draw(spark):
    """The former code shuffled and sketched a row for every draw of every model and observation."""
    from firmlens.catalog import draw_queries as Q

    folds = spark.createDataFrame([("row", "ex_post", f, [("M1", Q.FIRM_RE, 0.5 * f), ("M2", "pooled", 1.0)]) for f in (1, 2)], "scheme string, target_space string, fold_id int, _m array<struct<model_id:string,variant:string,pred_sd:double>>")
    wide = spark.createDataFrame([("row", "ex_post", f"c{i}", 2000, 1 + i % 2, 0.1 * i, [float(i), 0.5]) for i in range(9)], "scheme string, target_space string, company string, year int, fold_id int, y_actual double, preds array<double>")
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(Q, "predictions", lambda s, d: (wide, folds))
        rows, read, keys, models = Q.draw_matrices(spark, "")
        packed = {(r.model_key, r.company): r.predict for r in Q.packed_draws(spark, "").collect()}
    assert rows.count() == 9 and keys == ["model_key"] and {m for (m,) in models} == {m for m, _ in packed}
    batch = rows.select("fold_id", "y_actual", "preds").toArrow().combine_chunks().to_batches()[0]
    got = np.concatenate(list(read(batch)))
    for line in got:
        i = round(line[-1] * 10)
        for j, (m,) in enumerate(models):
            assert np.allclose(line[j * Q.N_DRAWS:(j + 1) * Q.N_DRAWS], packed[m, f"c{i}"], rtol=1e-12)
