"""Roll-ups of held-out scores count every score, those of firms without training rows too."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def held_out(spark):
    from firmlens.catalog import load_catalog

    q = load_catalog()[0]
    rows = q["reg8_held_out_scores"](spark, SF).toPandas()
    assert not rows["primary_row_target_inclusion"].all()  # some rows are no targets of row validation
    return q, rows


def test_score_rollup_counts_all_scores(spark, held_out):
    q, rows = held_out
    got = q["stk1_score_rollup"](spark, SF).toPandas()
    assert got["n_test_obs_total"].sum() == len(rows)
    assert got["elpd_kfold"].sum() == pytest.approx(rows["lpd_obs"].sum(), rel=1e-5)


def test_reliability_rests_on_all_scores(spark, held_out):
    q, rows = held_out
    got = q["stk2_reliability_flag"](spark, SF).toPandas().set_index(["scheme", "target_space", "model_id", "variant"])["min_ess_bulk"]
    from firmlens.catalog.model_queries import scores

    folds = scores(spark, SF).groupBy("scheme", "target_space", "model_id", "variant", "fold_id").count().toPandas()
    want = 1.5 * folds.groupby(["scheme", "target_space", "model_id", "variant"])["count"].min()
    assert got.sort_index().tolist() == want.sort_index().tolist()


def test_alignment_covers_all_observations(spark, held_out):
    q, rows = held_out
    got = q["stk3_alignment"](spark, SF).toPandas()
    assert got["n_obs"].sum() == len(rows[["scheme", "target_space", "company", "year"]].drop_duplicates())


def test_log_mean_exp_of_all_observations(spark, held_out):
    q, rows = held_out
    got = q["stk4_log_mean_exp"](spark, SF).toPandas()
    assert len(got) == len(rows[["scheme", "target_space", "company", "year"]].drop_duplicates()) and got["n"].sum() == len(rows)


def test_pseudo_bma_weighs_all_scores(spark, held_out):
    import numpy as np

    q, rows = held_out
    got = q["stk6_pseudo_bma"](spark, SF).toPandas()
    elpd = rows.groupby(["scheme", "target_space", "model_id", "variant"])["lpd_obs"].sum()
    want = elpd.groupby(level=[0, 1]).transform(lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum())
    both = got.set_index(["scheme", "target_space", "model_id", "variant"])["weight"]
    assert np.allclose(both.sort_index(), want.sort_index(), atol=2e-3)
