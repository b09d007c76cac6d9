"""Least squares, stacking and draw operators against numpy brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firmlens.operators import draws as D
from firmlens.operators import lsq
from firmlens.operators import stacking as ST
from firmlens.operators.infer import t_two_sided


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        u = rng.normal(scale=0.7)
        for t in range(2016, 2016 + 2 + i % 4):
            x, z = rng.normal(), rng.normal()
            rows.append((f"c{i}", t, "ABC"[i % 3], x, z, 0.5 * x - 0.3 * z + u + 0.1 * (t - 2016) + rng.normal(scale=0.5)))
    return pd.DataFrame(rows, columns=["company", "year", "industry", "x", "z", "y"])


def dummies(pdf, cols):
    parts = [np.ones((len(pdf), 1)), pdf[cols].to_numpy()]
    for f in ("industry", "year"):
        parts.append(pd.get_dummies(pdf[f], drop_first=True).to_numpy(dtype=float))
    return np.hstack(parts)


def test_ols_cluster_two_way(spark, data):
    sdf = spark.createDataFrame(data).repartition(5)
    design = lsq.Design(["y"], ["x", "z"], lsq.factor_levels(sdf, ["industry", "year"]))
    rows = design.project(sdf, ["company", "year"])
    fits = lsq.fit(lsq.cross_products(rows, [], design.values), [], design, {"m": (design.index(["x", "z"], ["industry", "year"]), 0)})
    X, y = dummies(data, ["x", "z"]), data.y.to_numpy()
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    e, inv, (n, k) = y - X @ b, np.linalg.inv(X.T @ X), X.shape

    def meat(g):
        s = pd.DataFrame(X * e[:, None]).groupby(g).sum().to_numpy()
        return len(s) / (len(s) - 1) * (n - 1) / (n - k) * inv @ s.T @ s @ inv

    co = lsq.coefficients(fits, [], design, ["x", "z"]).toPandas().set_index("term")
    assert co.loc["x", "estimate"] == pytest.approx(b[1]) and co.loc["z", "std_error"] == pytest.approx(np.sqrt(e @ e / (n - k) * inv[2, 2]))
    scored = lsq.residuals(rows, fits, [], design)
    one = lsq.clustered(fits, scored, [], design, ["x", "z"], [["company"]]).toPandas().set_index("term")
    v1 = meat(data.company.to_numpy())
    assert one.loc["x", "std_error"] == pytest.approx(np.sqrt(v1[1, 1]))
    two = lsq.clustered(fits, scored, [], design, ["x", "z"], [["company"], ["year"]]).toPandas().set_index("term")
    v = v1 + meat(data.year.to_numpy()) - meat((data.company + data.year.astype(str)).to_numpy())
    ev, vec = np.linalg.eigh((v + v.T) / 2)
    if ev.min() < 0:
        v = (vec * np.clip(ev, 0, None)) @ vec.T
    assert two.loc["z", "std_error"] == pytest.approx(np.sqrt(v[2, 2]))


def test_collinear_column_is_dropped(spark, data):
    sdf = spark.createDataFrame(data.assign(x2=2 * data.x))
    design = lsq.Design(["y"], ["x", "x2", "z"])
    fits = lsq.fit(lsq.cross_products(design.project(sdf, []), [], design.values), [], design, {"m": (design.index(["x", "x2", "z"]), 0)}).first()
    assert fits.dropped == ["x2"] and fits["rank"] == 3


def test_firm_effects_equal_dummies(spark, data):
    sdf = spark.createDataFrame(data)
    design = lsq.Design(["y"], ["x", "z"], lsq.factor_levels(sdf, ["year"]))
    rows = lsq.absorbed_rows(sdf, [], design, "company", ["year"])
    fits = lsq.fit(lsq.cross_products(rows, [], design.values), [], design, {"m": (design.index(["x", "z"], ["year"])[1:], 0)})
    X = np.hstack([data[["x", "z"]].to_numpy(), pd.get_dummies(data.company).to_numpy(dtype=float), pd.get_dummies(data.year, drop_first=True).to_numpy(dtype=float)])
    b, *_ = np.linalg.lstsq(X, data.y.to_numpy(), rcond=None)
    assert fits.first().beta[1:3] == pytest.approx(b[:2].tolist())


def test_random_intercept_maximises_likelihood(spark, data):
    sdf = spark.createDataFrame(data.assign(fold_id=1, k="a"))
    sdf = sdf.unionByName(sdf.limit(0))
    design = lsq.Design(["y"], ["x", "z"], lsq.factor_levels(sdf, ["year"]))
    rows = design.project(sdf.withColumn("fold_id", F.lit(2)), ["k", "company", "fold_id"])
    own = lsq.cross_products(rows, ["k"], design.values)
    sums = rows.groupBy("k", "company").agg(*[F.sum(v).alias(v) for v in design.values]).withColumn("n_train", F.round("x0").cast("int"))
    blocks = lsq.cross_products(sums, ["k", "n_train"], design.values)
    got = lsq.fit_random_intercept(own, blocks, ["k"], design, {"m": (design.index(["x", "z"], ["year"]), 0)}).first()
    X = np.hstack([np.ones((len(data), 1)), data[["x", "z"]].to_numpy(), pd.get_dummies(data.year, drop_first=True).to_numpy(dtype=float)])
    y, firms = data.y.to_numpy(), data.company.to_numpy()

    def loglik(lam):
        v = np.eye(len(y)) + lam * (firms[:, None] == firms[None, :])
        vi = np.linalg.inv(v)
        b = np.linalg.solve(X.T @ vi @ X, X.T @ vi @ y)
        r = y - X @ b
        s2 = r @ vi @ r / len(y)
        return -0.5 * (len(y) * (np.log(2 * np.pi * s2) + 1) + np.linalg.slogdet(v)[1]), b

    ll, b = loglik(got.lam)
    assert got.loglik == pytest.approx(ll) and got.beta[:3] == pytest.approx(b[:3].tolist())
    assert ll >= max(loglik(got.lam * f)[0] for f in (0.9, 0.99, 1.01, 1.1)) - 1e-7


def test_cv_scores_equal_refits(spark, data):
    from firmlens.plans import scoring

    rng = np.random.default_rng(5)
    pdf = data.rename(columns={"y": "ta_scaled", "x": "inv_a_lag", "z": "drev_scaled"}).assign(ppe_scaled=rng.normal(size=len(data)), target_space="real_time")
    pdf["fold_id"] = np.arange(len(pdf)) % 3 + 1
    got = scoring.cv_scores(spark.createDataFrame(pdf), {"real_time": ["M01"]}).toPandas()
    pooled = got[got.model_key == "M01_real_time_pooled"].set_index(["company", "year"])
    cols = ["inv_a_lag", "drev_scaled", "ppe_scaled"]
    X, y = dummies(pdf, cols), pdf.ta_scaled.to_numpy()
    for k in (1, 2, 3):
        tr, te = (pdf.fold_id != k).to_numpy(), (pdf.fold_id == k).to_numpy()
        b, *_ = np.linalg.lstsq(X[tr], y[tr], rcond=None)
        sd = np.sqrt(((y[tr] - X[tr] @ b) ** 2).sum() / (tr.sum() - X.shape[1]))
        for i in np.flatnonzero(te)[:5]:
            r = pooled.loc[(pdf.company[i], pdf.year[i])]
            assert r.pred_mean == pytest.approx(X[i] @ b) and r.pred_sd == pytest.approx(sd)
    assert (got.groupby("model_key").size() == len(pdf)).all()


def test_leave_one_firm_out(spark, data):
    sdf = spark.createDataFrame(data.assign(o="y"))
    design = lsq.Design(["y"], ["x", "z"])
    rows = design.project(sdf, ["o", "company"])
    out = lsq.leave_one_firm_out(rows, ["o"], design, design.index(["x", "z"]), ["x"]).toPandas().set_index("company")
    for c in ("c0", "c17"):
        d = data[data.company != c]
        b, *_ = np.linalg.lstsq(np.c_[np.ones(len(d)), d[["x", "z"]]], d.y, rcond=None)
        assert out.loc[c, "estimate"] == pytest.approx(b[1])


def test_t_tail():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided(0.1, 3) == pytest.approx(0.92664, abs=1e-4)
    assert t_two_sided(-12.0, 200) < 1e-20


def stack(spark, cols, **kw):
    rows = [("g", f"o{i}", k, float(v)) for k, vs in cols.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, obs string, model_key string, lpd_obs double")
    return {r.model_key: r.weight for r in ST.stack(df, ["g"], ["obs"], **kw).collect()}


def test_stacking_weights(spark):
    assert stack(spark, {"a": [-1, -2, -3]}) == {"a": 1.0}
    w = stack(spark, {"a": [5] * 8, "b": [-5] * 8})
    assert w["a"] > 0.99 and sum(w.values()) == pytest.approx(1)
    assert stack(spark, {"a": [1, 2, 3, 4], "b": [1, 2, 3, 4]})["a"] == pytest.approx(0.5)
    rng = np.random.default_rng(4)
    m = rng.normal(scale=1.5, size=(200, 4))
    w = stack(spark, {k: m[:, i] for i, k in enumerate("abcd")})
    v = np.array([w[k] for k in "abcd"])
    grad = (np.exp(m) / (np.exp(m) @ v)[:, None]).mean(axis=0)
    assert grad.max() <= 1 + 1e-6 and np.all(v >= 0)
    with pytest.raises(ValueError, match="same observations"):
        stack(spark, {"a": [1, 2], "b": [1]})
    with pytest.raises(ValueError, match="non-finite"):
        stack(spark, {"a": [1, float("nan")], "b": [1, 2]})


def test_stacking_optimum_drops_models_and_certifies(spark):
    """Fourteen models, most of them worse everywhere, groups of different members: the certificate holds and numpy agrees."""
    rng = np.random.default_rng(12)
    rows, dens = [], {}
    for g, k in (("g", 14), ("h", 5)):
        m = rng.normal(scale=0.7, size=(300, k)) - 0.3 * np.arange(k)
        dens[g] = np.exp(m)
        rows += [(g, f"o{i}", f"m{j:02d}", float(m[i, j])) for i in range(len(m)) for j in range(k)]
    out = ST.stack(spark.createDataFrame(rows, "g string, obs string, model_key string, lpd_obs double").repartition(5), ["g"], ["obs"]).toPandas()
    assert out.converged.all() and (out.kkt_gap < ST.KKT_TOL).all() and (out.weight == 0).any()
    for g, p in dens.items():
        w = out[out.g == g].sort_values("model_key").weight.to_numpy()
        v = np.full(p.shape[1], 1 / p.shape[1])
        for _ in range(20000):
            v = v * (p / (p @ v)[:, None]).mean(axis=0)
        assert w == pytest.approx(v, abs=2e-3) and np.log(p @ w).sum() >= np.log(p @ v).sum() - 1e-6
        assert out[out.g == g].objective.iloc[0] == pytest.approx(np.log(p @ w).sum())


def test_row_targets_need_history(spark):
    from firmlens.plans.scoring import with_inclusion

    folded = spark.createDataFrame([("s", "lone", 2016, 1), ("s", "two", 2016, 1), ("s", "two", 2017, 2), ("s", "same", 2016, 3), ("s", "same", 2017, 3)], "target_space string, company string, year int, fold_id int")
    got = {(r.company, r.year): r.primary_row_target_inclusion for r in with_inclusion(folded.withColumn("lpd_obs", F.lit(0.0)), folded).collect()}
    assert got == {("lone", 2016): False, ("two", 2016): True, ("two", 2017): True, ("same", 2016): False, ("same", 2017): False}


def test_mixture_plan_copies(spark):
    w = spark.createDataFrame([("g", "a", 0.7), ("g", "b", 0.3), ("g", "c", 1e-9)], "g string, model_key string, weight double")
    ids = w.select("g", "model_key").withColumn("draw_id", F.explode(F.sequence(F.lit(1), F.lit(4))))
    got = D.mixture_plan(w, ids, ["g"], 10).toPandas().groupby("model_key").copies
    assert got.sum().to_dict() == {"a": 7, "b": 3} and got.max().to_dict() == {"a": 2, "b": 1}


def test_normal_quantile(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, r in zip(ps, df.select(D.normal_quantile(F.col("p")).alias("z")).collect()):
        assert r.z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-7)


def test_pareto_smoothing_recovers_known_tail():
    rng = np.random.default_rng(6)
    for k in (0.2, 0.6):
        x = np.sort(0.8 * ((1 - rng.random(4000)) ** (-k) - 1) / k)
        shape, sigma = D.fit_generalised_pareto(x)
        assert shape == pytest.approx(k, abs=0.06) and sigma == pytest.approx(0.8, abs=0.08)
    ll = rng.normal(-1, 0.05, 4000)
    elpd, lpd, kk = D.smooth_weights(ll)
    assert kk < 0.5 and elpd == pytest.approx(-np.log(np.mean(np.exp(-ll))), abs=1e-3) and lpd >= elpd


def brute_ess(chains):
    m, n = chains.shape
    cov = np.array([[((c - c.mean())[: n - t] @ (c - c.mean())[t:]) / n for t in range(n)] for c in chains])
    w = (cov[:, 0] * n / (n - 1)).mean()
    vp = w * (n - 1) / n + chains.mean(axis=1).var(ddof=1)
    rho = 1 - (w - (cov * n / (n - 1)).mean(axis=0)) / vp
    rho[0] = 1
    tot, prev, t = 0.0, np.inf, 0
    while 2 * t + 1 < n and rho[2 * t] + rho[2 * t + 1] >= 0:
        prev = min(prev, rho[2 * t] + rho[2 * t + 1])
        tot, t = tot + prev, t + 1
    return m * n / max(-1 + 2 * tot, 1 / np.log10(m * n))


def test_autocovariance_blocks_and_ess(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=(4, 301))
    x = np.zeros_like(e)
    for t in range(1, 301):
        x[:, t] = 0.6 * x[:, t - 1] + e[:, t]
    x = x[:, 1:]
    rows = [("p", c, i + 1, float(v)) for c in range(4) for i, v in enumerate(x[c])]
    df = spark.createDataFrame(rows, "parameter string, half_chain long, pos long, x double")
    for block in (40, 4096):
        ac = D.autocovariance(df, ["parameter", "half_chain"], 16, block).toPandas()
        for c in range(4):
            d = x[c] - x[c].mean()
            got = ac[ac.half_chain == c].sort_values("lag").s.to_numpy()
            assert np.allclose(got, [d[: 300 - t] @ d[t:] for t in range(17)])
    from statistics import NormalDist

    dr = spark.createDataFrame([("p", c, i + 1, float(v)) for c in range(4) for i, v in enumerate(x[c])], "parameter string, chain long, iter long, value double")
    got = D.effective_sizes(dr, ["parameter"]).first()
    small = D.effective_sizes(dr, ["parameter"], block=4).first()  # the positive sequence is longer than the first ranges of lags
    assert (small.ess_bulk, small.ess_tail) == pytest.approx((got.ess_bulk, got.ess_tail), rel=1e-9)
    flat = D.effective_sizes(dr.withColumn("value", F.lit(1.0)), ["parameter"]).first()
    assert np.isnan(flat.ess_bulk) and np.isnan(flat.ess_tail)
    ranks = pd.Series(x.ravel()).rank().to_numpy().reshape(x.shape)
    z = np.vectorize(NormalDist().inv_cdf)((ranks - 0.375) / (x.size + 0.25)).reshape(8, 150)
    assert got.ess_bulk == pytest.approx(brute_ess(z), rel=1e-4)
    lo, hi = np.quantile(x, [0.05, 0.95])
    tail = min(brute_ess((x <= q).astype(float).reshape(8, 150)) for q in (lo, hi))
    assert got.ess_tail == pytest.approx(tail, rel=1e-6)
    rh = D.rank_rhat(dr, ["parameter"]).first()
    w, b = z.var(axis=1, ddof=1).mean(), z.mean(axis=1).var(ddof=1)
    assert rh.rhat_bulk == pytest.approx(np.sqrt((149 / 150 * w + b) / w), rel=1e-6) and rh.rhat >= rh.rhat_bulk


def test_large_mean_regressor_is_not_taken_for_the_intercept():
    import numpy as np

    from firmlens.operators.lsq import solve

    r = np.random.default_rng(1)
    x = 1e5 + r.standard_normal(500)
    a = np.c_[np.ones(500), x, 2 * x + 3, 5 + 2 * x + 0.1 * r.standard_normal(500)]
    beta, inv, rank, _ = solve(a.T @ a, [0, 1, 2], 3)
    assert rank == 2 and abs(beta[1] - 2) < 1e-2 and inv[2, 2] == 0


def test_negative_flag_and_clean_rows_ignore_nan(spark):
    from firmlens.functions.columns import negative_flag
    from firmlens.operators.panel import clean_rows, drop_counts

    rows = [("A", 2016, float("nan"), 1.0, 1.0, 1.0), ("B", 2016, 2.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "company string, year int, a double, rec double, ppe double, cogs double")
    assert [r[0] for r in df.select(negative_flag("a")).collect()] == [None, 0]
    assert clean_rows(df, 2015).count() == drop_counts(df, 2015).first().n_kept == 1


def test_folds_are_dealt_inside_the_dominant_industry(spark):
    from firmlens.operators.cv import grouped_folds

    rows = [("A", y, "Z" if y > 2015 else "B") for y in (2015, 2016, 2017)] + [("C", 2015, "Y"), ("C", 2016, "X")]
    got = {r.company: r.industry for r in grouped_folds(spark.createDataFrame(rows, "company string, year int, industry string"), 2).collect()}
    assert got == {"A": "Z", "C": "X"}


def test_downdating_equals_refits_and_reports_lost_terms(spark, data):
    pdf = data.assign(o="y", only=(data.company == "c3").astype(float))
    design = lsq.Design(["y"], ["x", "z", "only"])
    rows = design.project(spark.createDataFrame(pdf), ["o", "company"])
    out = lsq.leave_one_firm_out(rows, ["o"], design, design.index(["x", "z", "only"]), ["x", "only"], batch=7).toPandas()
    assert len(out) == 2 * pdf.company.nunique()
    for (c, term), got in out.set_index(["company", "term"]).estimate.items():
        d = pdf[pdf.company != c]
        cols = ["x", "z"] + (["only"] if d.only.any() else [])
        b, *_ = np.linalg.lstsq(np.c_[np.ones(len(d)), d[cols]], d.y, rcond=None)
        if term == "only" and c == "c3":
            assert np.isnan(got)
        else:
            assert got == pytest.approx(b[1 if term == "x" else 3], rel=1e-8)
    full = spark.createDataFrame([("y", "x", 1.0), ("y", "only", 1.0)], "o string, term string, estimate double")
    got = lsq.influence_summary(spark.createDataFrame(out), full, ["o"]).toPandas().set_index("term")
    assert got.loc["x", ["firms_dropped_n", "not_estimable_n"]].tolist() == [pdf.company.nunique(), 0]
    assert got.loc["only", ["firms_dropped_n", "not_estimable_n"]].tolist() == [pdf.company.nunique() - 1, 1]


def test_two_factors_of_2000_levels_equal_dummies(spark):
    from firmlens.operators.absorb import absorbed_ols

    rng = np.random.default_rng(5)
    n, levels = 40_000, 2_000
    f, g = rng.integers(0, levels, n), rng.integers(0, levels, n)
    f[: n // 3] = 0  # one level holds a third of the rows
    x = rng.normal(size=n) + 0.3 * (f % 7) + 0.2 * (g % 5)
    y = 1.5 * x + np.sin(f) + np.cos(g) + rng.normal(size=n)
    pdf = pd.DataFrame({"k": "a", "f": f, "g": g, "x": x, "y": y})
    out = absorbed_ols(spark.createDataFrame(pdf), ["k"], "y", ["x"], ["f", "g"]).first()
    lf, lg = np.unique(f, return_inverse=True)[1], np.unique(g, return_inverse=True)[1]
    p = 1 + lf.max() + 1 + lg.max()  # the first level of g is the base
    gram, right = np.zeros((p, p)), np.zeros(p)
    a, b = 1 + lf, 1 + lf.max() + lg  # column of g's level; the base falls on f's last column and is masked
    use = lg > 0
    gram[0, 0], right[0] = x @ x, x @ y
    np.add.at(gram, (a, a), 1.0), np.add.at(gram[0], a, x), np.add.at(right, a, y)
    b = 1 + lf.max() + lg
    np.add.at(gram, (b[use], b[use]), 1.0), np.add.at(gram[0], b[use], x[use]), np.add.at(right, b[use], y[use])
    np.add.at(gram, (a[use], b[use]), 1.0)
    gram = np.triu(gram) + np.triu(gram, 1).T
    beta = np.linalg.solve(gram, right)
    rss = y @ y - beta @ right
    se = np.sqrt(rss / (n - p) * np.linalg.solve(gram, np.eye(p)[0])[0])
    assert (out["n"], out["rank"]) == (n, p)
    assert out["estimate"] == pytest.approx(beta[0], rel=1e-8) and out["std_error"] == pytest.approx(se, rel=1e-8)


def test_absorbed_rank_counts_separate_parts(spark):
    from firmlens.operators.absorb import absorbed_ols

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"f": np.repeat(np.arange(12), 6), "x": rng.normal(size=72), "y": rng.normal(size=72)})
    pdf["g"] = (pdf.f // 4) * 3 + rng.integers(0, 3, 72)  # three groups that share no level
    pdf.loc[70, "g"] = np.nan
    sdf = spark.createDataFrame(pdf).withColumn("g", F.when(~F.isnan("g"), F.col("g")))
    out = absorbed_ols(sdf, [], "y", ["x"], ["f", "g"]).first()
    d = pdf.dropna()
    full = np.c_[d.x, pd.get_dummies(d.f).to_numpy(float), pd.get_dummies(d.g).to_numpy(float)]
    b, _, rank, _ = np.linalg.lstsq(full, d.y, rcond=None)
    assert (out["n"], out["rank"]) == (71, rank) and out["estimate"] == pytest.approx(b[0])


def test_exclusion_list_names_failed_and_missing_gates(spark):
    cand = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "model_id string")
    gate = spark.createDataFrame([("a", "PASS"), ("b", "FAIL"), ("d", "REVIEW"), ("z", "FAIL")], "model_id string, mcmc_status string")
    got = {r.model_id: (r.gate_status, r.reason) for r in ST.exclusion_list(cand, gate, ["model_id"], "mcmc_status").collect()}
    assert got == {"b": ("FAIL", "gate_status_fail"), "c": ("MISSING", "gate_status_missing")}


def test_specification_grid_keeps_outcome_sets_and_reports_thin_keys(spark):
    from firmlens.plans import scoring

    rng, n = np.random.default_rng(1), 80
    pdf = pd.DataFrame({"score": ["a"] * 70 + ["b"] * 10, "outcome": "future_cfo", "company": [f"c{i % 20}" for i in range(n)], "year": 1996 + np.arange(n) // 20,
                        "industry": "X", "t": rng.normal(size=n), "size": rng.normal(size=n), "y": rng.normal(size=n)})
    specs = {"core": (["size"], ["year"], "firm", False), "other": (["size"], ["year"], "firm", False)}
    out = scoring.specification_grid(spark.createDataFrame(pdf), ["score", "outcome"], ["t"], specs, outcome_sets={"core": ["accrual_reversal"], "other": ["future_cfo"]})
    got = {(r.score, r.spec): r for r in out.collect()}
    assert set(got) == {("a", "other"), ("b", "other")} and got["b", "other"].se_status == "insufficient_variation"
    d = pdf[pdf.score == "a"]
    full = np.c_[np.ones(len(d)), d[["t", "size"]], pd.get_dummies(d.year, drop_first=True).to_numpy(float)]
    b, *_ = np.linalg.lstsq(full, d.y, rcond=None)
    fit = got["a", "other"]
    assert fit.estimate == pytest.approx(b[1]) and fit.r2 == pytest.approx(1 - ((d.y - full @ b) ** 2).sum() / ((d.y - d.y.mean()) ** 2).sum())
