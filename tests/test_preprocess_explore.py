import numpy as np
import pytest

from valora.operators import explore, metrics, preprocess


def test_unseen_category_and_ordinal_unknown(spark):
    tr = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    te = spark.createDataFrame([("a",), ("zz",), (None,)], "c string")
    oh = preprocess.OneHot(["c"]).fit(tr)
    assert oh.output_columns() == ["c_a", "c_b"]
    rows = oh.transform(te).collect()
    assert [(r.c_a, r.c_b) for r in rows] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]
    oc = preprocess.OrdinalCodes(["c"]).fit(tr)
    assert [r.c for r in oc.transform(te).collect()] == [0, -1, -1]


def test_ordinal_codes_table_mode(spark):
    tr = spark.createDataFrame([(f"v{i:03d}",) for i in range(30)], "c string")
    m = preprocess.OrdinalCodes(["c"], literal_levels=5).fit(tr)  # forces the distributed table
    got = {r.c_orig: r.c for r in m.transform(tr.withColumn("c_orig", tr.c)).collect()}
    assert got == {f"v{i:03d}": i for i in range(30)}


def test_impute_and_standardize_edge_cases(spark):
    df = spark.createDataFrame([(5.0, None, 1.0, "x"), (5.0, None, None, None), (5.0, None, 3.0, "y")],
                               "k double, empty double, m double, s string")
    imp = preprocess.Impute(median=["k", "empty", "m"], constant={"s": "None"}).fit(df)
    assert imp.dropped == ["empty"]
    out = imp.transform(df)
    assert "empty" not in out.columns
    assert [r.m for r in out.collect()] == [1.0, 2.0, 3.0]
    assert [r.s for r in out.collect()] == ["x", "None", "y"]
    st = preprocess.Standardize(["k", "m"]).fit(out)
    z = st.transform(out).collect()
    assert [r.k for r in z] == [0.0, 0.0, 0.0]  # constant column: sd 0 -> 1
    assert z[0].m == pytest.approx(-1 / np.std([1.0, 2.0, 3.0]))  # population sd


def test_polynomial_terms(spark):
    df = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    p = preprocess.Polynomial(["a", "b"], degree=3)
    assert p.output_columns()[:5] == ["a", "b", "a_pow2", "a_x_b", "b_pow2"]
    r = p.transform(df).first()
    assert (r.a_pow2, r.a_x_b, r.a_pow2_x_b, r.b_pow3) == (4.0, 6.0, 12.0, 27.0)
    with pytest.raises(ValueError):
        preprocess.Polynomial([f"c{i}" for i in range(100)], degree=3, max_width=1000).terms()


def test_pipeline_feature_names(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None)], "x double, c string")
    m = preprocess.build_pipeline(["x"], ["c"]).fit(df)
    assert preprocess.feature_names(m) == ["num__x", "cat__c_None", "cat__c_a", "cat__c_b"]


def test_corr_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 5.0, 2.0), (2.0, 5.0, 4.1), (3.0, 5.0, 5.9), (None, 5.0, 1.0)],
                               "a double, k double, b double")
    m = {(r.a, r.b): r.r for r in explore.corr_matrix(df, ["a", "k", "b"]).collect()}
    assert m[("a", "k")] is None
    assert m[("a", "b")] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 5.9])[0, 1])


def test_box_stats_against_numpy(spark):
    rng = np.random.default_rng(3)
    vals = list(rng.lognormal(2, 1, 400))
    df = spark.createDataFrame([("g", float(v)) for v in vals], "g string, y double")
    r = explore.box_stats(df, "g", "y").first()
    q1, q3 = np.quantile(vals, [0.25, 0.75])
    inside = [v for v in vals if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert r.q1 == pytest.approx(q1) and r.q3 == pytest.approx(q3)
    assert r.whisker_hi == pytest.approx(max(inside)) and r.n_fliers == len(vals) - len(inside)


def test_cardinality_gate(spark):
    df = spark.createDataFrame([(i % 3, i, "x") for i in range(100)], "a int, b int, c string")
    got = {r.column: (r.n_distinct, r.kept) for r in explore.cardinality(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (3, 1), "b": (100, 0), "c": (1, 0)}


def test_select_model_tie_goes_to_baseline(spark):
    m = spark.createDataFrame([("tuned", 1, 10.0), ("base", 0, 10.0)], "model string, is_tuned int, rmse double")
    assert metrics.select_model(m).first().model == "base"


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    r = metrics.regression_metrics(df, "y", "p").first()
    assert r.rmse == pytest.approx(np.sqrt(2 / 3)) and r.r2 == pytest.approx(1 - 2 / 8)


def test_corr_wide_path_matches_narrow(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 5)) @ rng.normal(size=(5, 5)) + 100.0
    rows = [tuple(None if (i + j) % 17 == 0 else float(X[i, j]) for j in range(5)) for i in range(300)]
    rows = [r + (7.0,) for r in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, k double")
    cols = ["a", "b", "c", "d", "e", "k"]
    narrow = {(r.a, r.b): r.r for r in explore.corr_matrix(df, cols).collect()}
    wide = {(r.a, r.b): r.r for r in explore.corr_matrix(df, cols, wide_from=2).collect()}
    assert narrow.keys() == wide.keys()
    for key, v in narrow.items():
        assert (v is None and wide[key] is None) or wide[key] == pytest.approx(v, abs=1e-10)


def test_pca_share_matches_numpy(spark):
    rng = np.random.default_rng(9)
    X = rng.normal(size=(300, 6)) @ np.diag([5.0, 3.0, 2.0, 1.0, 0.5, 0.1])
    df = spark.createDataFrame([(i, [float(v) for v in X[i]]) for i in range(300)], "id long, v array<double>")
    m = preprocess.Pca("v", 0.95).fit(df)
    ev = np.sort(np.linalg.eigvalsh(np.cov(X, rowvar=False)))[::-1]
    share = ev / ev.sum()
    assert np.allclose(m.ratios, share, atol=1e-10)
    assert m.k == int(np.searchsorted(np.cumsum(share), 0.95) + 1)
    proj = np.array([r.pca for r in m.transform(df).orderBy("id").collect()])
    Xc = X - X.mean(0)
    assert proj.shape == (300, m.k)
    # projections equal the centred data times the top eigenvectors, up to sign
    w, V = np.linalg.eigh(np.cov(X, rowvar=False))
    ref = Xc @ V[:, ::-1][:, :m.k]
    assert np.allclose(np.abs(proj), np.abs(ref), atol=1e-8)


def test_one_hot_width_guard_and_targeted_zero(spark):
    df = spark.createDataFrame([(f"v{i}", float(i) if i % 2 else None, None if i % 3 else 5.0) for i in range(30)],
                               "c string, area double, q double")
    with pytest.raises(ValueError):
        preprocess.OneHot(["c"], max_levels=10).fit(df)  # refuses, never truncates levels
    m = preprocess.Impute(median=["q"], zero=["area"]).fit(df)
    rows = m.transform(df).collect()
    assert all(r.area is not None for r in rows) and rows[0].area == 0.0
    assert all(r.q == 5.0 for r in rows)
