"""Nothing is lost or cut: NaN cells, infinite values, name clashes, CSV types."""
import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.functions.quantiles import exact_quantiles
from valora.operators import explore, features, linear, preprocess, selection
from valora.sources import normalize_nulls, read_table


@pytest.mark.parametrize("extra", [[math.inf], [-math.inf, math.inf], [1.7e308, -1.7e308], [5e-324, 1e308]])
def test_extreme_values_cost_passes_not_collects(spark, extra):
    rng = np.random.default_rng(1)
    values = [*rng.normal(size=3000).tolist(), *extra]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "v double, g int").repartition(4)
    probs = [0.1, 0.5, 0.77]
    got = exact_quantiles(df, "v", probs, leaf_rows=64)
    assert all(math.isclose(got[q], np.quantile(values, q), rel_tol=1e-12) for q in probs)
    by = {(r["g"], r["prob"]): r["quantile"] for r in exact_quantiles(df, "v", probs, by=["g"], leaf_rows=64).collect()}
    for g in (0, 1):
        own = values[g::2]
        assert all(math.isclose(by[g, q], np.quantile(own, q), rel_tol=1e-12) for q in probs)


def test_quantiles_over_many_decades(spark):
    values = [10.0 ** e for e in range(-300, 300)] * 3
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert math.isclose(exact_quantiles(df, "v", [0.5], leaf_rows=8)[0.5], np.quantile(values, 0.5))


def test_nan_is_imputed_and_no_row_is_lost(spark, tmp_path):
    rows = [(i, float("nan") if i % 4 == 0 else float(i), 2.0 * i) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    assert normalize_nulls(df).where("x is null").count() == 10
    with pytest.raises(ValueError, match="missing"):
        linear.gram(df, ["x"], "y")
    done = preprocess.Impute(median=["x"]).fit(df).transform(df)
    assert linear.gram(done, ["x"], "y").total.n == 40
    assert preprocess.Standardize(["x"]).fit(done).sd["x"] > 0


def test_csv_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c,d\n1,1.5,x,NA\nNone,null, NA ,None\n3,NaN,,NaN\n")
    df = read_table(spark, [f"file://{tmp_path}/t.csv"])
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string"]
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, "x", None), (None, None, " NA ", None), (3, None, None, None)]


def test_one_hot_names_are_unique_over_columns(spark):
    df = spark.createDataFrame([("b_c", "c"), ("z", "q")], "a string, a_b string")
    m = preprocess.OneHot(["a", "a_b"]).fit(df)
    names = m.output_columns()
    assert len(set(names)) == 4
    assert [sum(r) for r in m.transform(df).select(*names).collect()] == [2.0, 2.0]


def test_polynomial_of_scaled_columns(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (6.0,)], "x double")
    pipe = preprocess.build_pipeline(["x"], poly_degree=2).fit(df)
    got = np.array([list(r) for r in pipe.transform(df).select(*preprocess.feature_columns(pipe)).collect()])
    z = (np.array([1, 2, 6]) - 3) / np.std([1, 2, 6])
    assert np.allclose(got, np.stack([z, z * z], axis=1))
    assert preprocess.feature_names(pipe) == ["num__x", "num__x_pow2"]


def test_loo_without_intercept_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 2)) + 1
    y = x @ [1.0, -2.0] + rng.normal(size=30)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id int, a double, b double, y double")
    g = linear.gram(df, ["a", "b"], "y")
    m = linear.fit_ridge(g, 0.5, intercept=False)
    got = linear.loo_residuals(df, g, m, "y", "id", alpha=0.5, intercept=False).orderBy("id").toPandas()["loo_residual"]
    want = []
    for i in range(30):
        k = np.arange(30) != i
        w = np.linalg.solve(x[k].T @ x[k] + 0.5 * np.eye(2), x[k].T @ y[k])
        want.append(y[i] - x[i] @ w)
    assert np.allclose(got, want)


def test_selection_refits_the_winner_on_all_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    df = spark.createDataFrame([(i, float(v), float(3 * v + e)) for i, (v, e) in enumerate(zip(x, rng.normal(size=400)))],
                               "id int, x double, y double")
    c = selection.select_and_refit(df, ["x"], "y", "y", "id", lambda g: {"heavy": (1e6, True)})
    assert c.name == "baseline" and set(c.scores) == {"baseline", "heavy"}
    whole = linear.fit_ridge(linear.gram(df, ["x"], "y"), 0.0)
    assert np.allclose(c.model.coef, whole.coef) and math.isclose(c.model.intercept, whole.intercept, abs_tol=1e-9)
    assert selection.choose({"baseline": 1.0, "tuned": 1.0}) == "baseline"
    with pytest.raises(ValueError):
        selection.choose({"baseline": None, "tuned": 1.0})
    with pytest.raises(ValueError):
        selection.select_and_refit(df.limit(0), ["x"], "y", "y", "id", lambda g: {})


def test_correlation_skips_nan(spark):
    rows = [(float(i), float("nan") if i == 3 else 2.0 * i + (i % 3), 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    keep = [r for r in rows if r[1] == r[1]]
    want = np.corrcoef([r[0] for r in keep], [r[1] for r in keep])[0, 1]
    for wide in (1, 24):
        m = {(r["a"], r["b"]): r["r"] for r in explore.corr_matrix(df, ["a", "b", "c"], wide_from=wide).collect()}
        assert math.isclose(m["a", "b"], want, rel_tol=1e-9) and m["a", "c"] is None
    ranked = {r["feature"]: r["r"] for r in explore.corr_rank(df, ["b", "c"], "a").collect()}
    assert math.isclose(ranked["b"], want, rel_tol=1e-9) and "c" not in ranked


def test_engineer_without_type_columns(spark):
    df = spark.createDataFrame([(1, 10.0, 5.0, 2.0)],
                               "Id int, SwimmingPoolArea double, BasementFacilitySF1 double, BasementFacilitySF2 double")
    out = features.engineer(df, {"porch": None})
    assert out.count() == 1 and "TotalPoolScore" not in out.columns


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\n"
        "from valora.session import local_session, ship_package\n"
        "s = local_session(2); ship_package(s)\n"
        "from valora.operators import knn\n"
        "d = s.createDataFrame([(i, [float(i), 0.0], float(i)) for i in range(8)], 'id int, v array<double>, y double')\n"
        "print('ROWS', knn.knn_regress(d, d, 'id', 'v', 'y', 1).count())\n")
    import pathlib
    root = str(pathlib.Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, capture_output=True, text=True, timeout=200)
    assert "ROWS 8" in done.stdout, done.stderr[-2000:]
