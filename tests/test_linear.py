"""Linear family against numpy closed forms on a seeded random fixture:
200 rows, 3 numeric + 1 categorical (4 levels), known weights."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.operators import folds, linear, preprocess


@pytest.fixture(scope="module")
def fixture(spark):
    rng = np.random.default_rng(7)
    n = 200
    X = rng.normal(size=(n, 3)) * [1.0, 10.0, 0.1] + [5.0, -2.0, 0.0]
    cat = rng.integers(0, 4, n)
    y = 3.0 + X @ [1.5, -0.2, 4.0] + np.array([0.0, 1.0, -1.0, 2.0])[cat] + rng.normal(0, 0.5, n)
    rows = [(i, *map(float, X[i]), f"c{cat[i]}", float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, c string, y double")
    oh = preprocess.OneHot(["c"]).fit(df)
    df = folds.assign_folds(oh.transform(df), "id", 5).repartition(4)
    feats = ["x1", "x2", "x3"] + oh.output_columns()
    pdf = df.toPandas().sort_values("id")
    return df, feats, pdf


def _np(pdf, feats):
    return pdf[feats].to_numpy(float), pdf["y"].to_numpy(float), pdf["fold"].to_numpy()


def test_ols_min_norm_matches_lstsq(fixture):
    df, feats, pdf = fixture
    X, y, _ = _np(pdf, feats)
    g = linear.gram(df, feats, "y")
    m = linear.fit_ridge(g, 0.0)
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.lstsq(Xc, yc, rcond=None)[0]  # rank-deficient (full one-hot + intercept)
    assert np.allclose(m.coef, w, atol=1e-8)
    assert m.intercept == pytest.approx(y.mean() - X.mean(0) @ w, abs=1e-8)


def test_ridge_per_fold_with_refit_scaler(fixture):
    df, feats, pdf = fixture
    X, y, fo = _np(pdf, feats)
    mask = [True, True, True] + [False] * 4
    g = linear.gram(df, feats, "y", fold_col="fold")
    for f in range(5):
        tr = fo != f
        Xt, yt = X[tr], y[tr]
        mu, sd = Xt.mean(0), Xt.std(0)
        d = np.where(mask, sd, 1.0)
        Z = (Xt - mu) / d
        a = 3.0
        ws = np.linalg.solve((Z - Z.mean(0)).T @ (Z - Z.mean(0)) + a * np.eye(7), (Z - Z.mean(0)).T @ (yt - yt.mean()))
        w = ws / d
        b = yt.mean() - Xt.mean(0) @ w
        m = linear.fit_ridge(g, a, True, mask, stats=g.train(f))
        assert np.allclose(m.coef, w, atol=1e-9) and m.intercept == pytest.approx(b, abs=1e-9)
        va = fo == f
        sse = float(((y[va] - b - X[va] @ w) ** 2).sum())
        assert linear.sse(g, g.folds[f], m) == pytest.approx(sse, rel=1e-9)


def test_ridge_without_intercept(fixture):
    df, feats, pdf = fixture
    X, y, _ = _np(pdf, feats)
    mask = [True, True, True] + [False] * 4
    g = linear.gram(df, feats, "y")
    m = linear.fit_ridge(g, 2.0, False, mask)
    d = np.where(mask, X.std(0), 1.0)
    C = np.where(mask, X.mean(0), 0.0)
    Z = (X - C) / d
    ws = np.linalg.solve(Z.T @ Z + 2.0 * np.eye(7), Z.T @ y)
    pred = Z @ ws
    got = m.transform(df.orderBy("id")).select("prediction").toPandas()["prediction"].to_numpy()
    assert np.allclose(got, pred, atol=1e-8)


def _cd_numpy(X, y, alpha, r, iters=20000):
    n, p = X.shape
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.zeros(p)
    for _ in range(iters):
        for j in range(p):
            rho = Xc[:, j] @ (yc - Xc @ w + Xc[:, j] * w[j]) / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * r, 0) / (Xc[:, j] @ Xc[:, j] / n + alpha * (1 - r))
    return w


def test_lasso_and_enet_match_coordinate_descent(fixture):
    df, feats, pdf = fixture
    X, y, _ = _np(pdf, feats[:3])[0], _np(pdf, feats)[1], None
    g = linear.gram(df, feats[:3], "y")
    for r in (1.0, 0.5):
        m = linear.fit_elastic_net(g, 0.3, r, tol=1e-12)
        assert np.allclose(m.coef, _cd_numpy(X, y, 0.3, r, 300), atol=1e-6)


def test_enet_ratio_one_is_lasso(fixture):
    df, feats, _ = fixture
    g = linear.gram(df, feats, "y")
    a = linear.fit_elastic_net(g, 0.05, 1.0, scale_mask=[True] * 3 + [False] * 4)
    b = linear.fit_elastic_net(g, 0.05, 1.0, scale_mask=[True] * 3 + [False] * 4)
    assert np.allclose(a.coef, b.coef)
    gf = linear.gram(df, feats, "y", fold_col="fold")
    path, best = linear.elastic_net_path(gf, [1.0], 10)
    assert len(path) == 10 * len(gf.folds) and best.info["l1_ratio"] == 1.0


def test_bayes_ridge_matches_svd_form(fixture):
    df, feats, pdf = fixture
    X, y, _ = _np(pdf, feats[:3])[0], _np(pdf, feats)[1], None
    g = linear.gram(df, feats[:3], "y")
    m = linear.fit_bayes_ridge(g, max_iter=300)
    # reference algorithm (MacKay updates on the SVD of centred X)
    Xc, yc = X - X.mean(0), y - y.mean()
    n = len(y)
    U, S, Vh = np.linalg.svd(Xc, full_matrices=False)
    ev = S ** 2
    al, la = 1.0 / (np.var(y) + np.finfo(float).eps), 1.0
    Xty = Xc.T @ yc
    w_old = None
    for it in range(300):
        w = Vh.T @ (Vh / (ev + la / al)[:, None]) @ Xty
        rmse = ((yc - Xc @ w) ** 2).sum()
        gamma = (al * ev / (la + al * ev)).sum()
        la = (gamma + 2e-6) / ((w ** 2).sum() + 2e-6)
        al = (n - gamma + 2e-6) / (rmse + 2e-6)
        if it != 0 and np.abs(w_old - w).sum() < 1e-3:
            break
        w_old = w.copy()
    w = Vh.T @ (Vh / (ev + la / al)[:, None]) @ Xty
    assert np.allclose(m.coef, w, rtol=1e-8, atol=1e-10)
    assert m.info["alpha_"] == pytest.approx(al, rel=1e-8)


def test_loo_matches_brute_force(fixture, spark):
    df, feats, pdf = fixture
    X, y, _ = _np(pdf, feats[:3])[0], _np(pdf, feats)[1], None
    g = linear.gram(df, feats[:3], "y")
    m = linear.fit_ridge(g, 1.0)
    r = linear.loo_residuals(df, g, m, "y", "id", alpha=1.0).orderBy("id").toPandas()
    brute = []
    for i in range(len(y)):
        k = np.arange(len(y)) != i
        Xk, yk = X[k], y[k]
        mu, my = Xk.mean(0), yk.mean()
        w = np.linalg.solve((Xk - mu).T @ (Xk - mu) + np.eye(3), (Xk - mu).T @ (yk - my))
        brute.append(y[i] - (my + (X[i] - mu) @ w))
    assert np.allclose(r["loo_residual"].to_numpy(), brute, atol=1e-9)


def test_gram_partition_invariance(fixture):
    df, feats, _ = fixture
    a = linear.gram(df.coalesce(1), feats, "y", fold_col="fold")
    b = linear.gram(df.repartition(8), feats, "y", fold_col="fold")
    for f in a.fold_ids():
        assert np.allclose(a.folds[f].sxx, b.folds[f].sxx) and a.folds[f].n == b.folds[f].n


def test_folds_disjoint_and_stable(spark):
    df = spark.range(0, 3000).withColumnRenamed("id", "k")
    a = folds.assign_folds(df.coalesce(1), "k", 5).toPandas().sort_values("k")
    b = folds.assign_folds(df.repartition(8), "k", 5).toPandas().sort_values("k")
    assert (a["fold"].to_numpy() == b["fold"].to_numpy()).all()
    assert set(a["fold"]) == {0, 1, 2, 3, 4}
    bl = folds.block_folds(df.repartition(5), "k", 4).toPandas().sort_values("k")
    assert list(bl.groupby("fold").size()) == [750, 750, 750, 750]
    assert (np.diff(bl["fold"].to_numpy()) >= 0).all()
    s = folds.split(df, "k", 0.15).agg(F.avg("is_test")).first()[0]
    assert 0.12 < s < 0.18


def test_levels_and_products_are_made_in_the_tasks(spark):
    """Statistics of category columns and factors are those of a column a level and product."""
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b), c, d, float(y), i % 3) for i, (a, b, c, d, y) in enumerate(zip(
        rng.normal(size=90), rng.normal(2, 1, 90), rng.choice(["u", "v", "w"], 90), rng.choice(["p", "q"], 90), rng.normal(5, 1, 90)))]
    rows[4] = (*rows[4][:3], None, "new", *rows[4][5:])  # neither has a level
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, d string, y double, fold int").repartition(3)
    pipe = preprocess.Pipeline(stages=[preprocess.Polynomial(["a", "b"]), preprocess.OneHot(["c", "d"])]).fit(df.where("id <> 4"))
    feats = ["a", "b", "a_pow2", "a_x_b", "b_pow2", *pipe.stages[1].output_columns()]
    assert len(feats) == 10
    few, indicators, products = preprocess.compact(pipe, df)
    assert few.columns == df.columns
    zero = {c: 0.0 for c in [*feats, "y"]}
    want = linear.gram(pipe.transform(df), feats, "y", "fold", zero)
    got = linear.gram(few, feats[::-1], "y", "fold", zero, indicators, products)
    assert got.fold_ids() == want.fold_ids() == [0, 1, 2]
    for f in got.folds:
        a, b = got.folds[f], want.folds[f]
        assert a.n == b.n and np.allclose(a.sxx[::-1, ::-1], b.sxx) and np.allclose(a.sx[::-1], b.sx)
        assert np.allclose(a.sxy[::-1], b.sxy) and np.isclose(a.syy, b.syy)
    auto = linear.gram(few, feats, "y", "fold", None, indicators, products)
    assert np.allclose(linear.fit_ridge(auto, 1.0).coef, linear.fit_ridge(want, 1.0).coef, atol=1e-9)
    with pytest.raises(ValueError, match="missing"):
        linear.gram(few.selectExpr("CASE WHEN id > 0 THEN a END AS a", "b", "c", "d", "y", "fold"), feats, "y", "fold", zero, indicators, products)


@pytest.mark.parametrize("keys", [list(range(23)), [7] * 23, [None] * 9 + list(range(14)), [1] * 4 + [2] * 11 + [None] * 2, [3, 1], []])
def test_block_folds_sort_the_keys_only(spark, monkeypatch, keys):
    """Fold sizes hold with repeated and null keys, and no other column is sorted."""
    seen, real = [], folds.global_index
    monkeypatch.setattr(folds, "global_index", lambda df, *a, **b: seen.append(df.columns) or real(df, *a, **b))
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long").repartition(3)
    got = folds.block_folds(df, "k", 5).collect()
    assert seen and all(len(c) == 1 for c in seen)
    assert sorted(r["i"] for r in got) == list(range(len(keys)))
    order = sorted(got, key=lambda r: (r["k"] is not None, r["k"] or 0, r["fold"]))
    assert [r["fold"] for r in order] == [int(f) for f, part in enumerate(np.array_split(np.arange(len(keys)), 5)) for _ in part]
