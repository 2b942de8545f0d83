import numpy as np
import pytest

from valora.operators import knn, search, trees
from valora.operators.preprocess import assemble


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    B = rng.normal(size=(60, 4))
    Q = rng.normal(size=(15, 4))
    lab = rng.integers(0, 5, 60).astype(float)
    base = spark.createDataFrame([(i, [float(x) for x in B[i]], float(lab[i])) for i in range(60)],
                                 "id long, v array<double>, y double")
    q = spark.createDataFrame([(100 + i, [float(x) for x in Q[i]]) for i in range(15)], "id long, v array<double>")
    for metric in ("euclidean", "manhattan"):
        for w in ("uniform", "distance"):
            got = {r.id: r.prediction for r in knn.knn_regress(q, base, "id", "v", "y", 5, w, metric).collect()}
            for i in range(15):
                d = (np.abs(B - Q[i]).sum(1) if metric == "manhattan" else np.sqrt(((B - Q[i]) ** 2).sum(1)))
                nn = np.lexsort((np.arange(60), d))[:5]
                exp = lab[nn].mean() if w == "uniform" else (lab[nn] / d[nn]).sum() / (1 / d[nn]).sum()
                assert got[100 + i] == pytest.approx(exp)


def test_knn_zero_distance_and_chunks(spark):
    base = spark.createDataFrame([(1, [0.0, 0.0], 10.0), (2, [0.0, 0.0], 20.0), (3, [1.0, 0.0], 99.0)],
                                 "id long, v array<double>, y double")
    q = spark.createDataFrame([(9, [0.0, 0.0])], "id long, v array<double>")
    p = knn.knn_regress(q, base, "id", "v", "y", 3, "distance").first().prediction
    assert p == 15.0
    nb = knn.knn_neighbours(q, base, "id", "v", "y", 2, chunk_bytes=40)  # several chunks
    assert [r.nb_key for r in nb.orderBy("nb_rank").collect()] == [1, 2]


def test_search_sampling_reproducible():
    space = {"alpha": ("log-uniform", 1e-6, 10.0), "fit_intercept": ("choice", [True, False]),
             "n": ("int", 1, 10)}
    a, b = search.sample(space, 5, seed=1), search.sample(space, 5, seed=1)
    assert a == b and all(1e-6 <= c["alpha"] <= 10 and 1 <= c["n"] <= 10 for c in a)
    best, score, hist = search.search(lambda cs: [abs(np.log10(c["alpha"]) + 2) for c in cs], space, 12, 2)
    assert len(hist) == 12 and score == min(s for _, _, s in hist)
    assert len(search.grid({"a": [1, 2], "b": [3, 4, 5]})) == 6


def test_tree_parameter_mapping():
    rf = trees.forest(max_depth=None, min_leaf=1, min_split=5, max_features=0.5)
    assert rf.getMaxDepth() == 30 and rf.getMinInstancesPerNode() == 3
    assert rf.getFeatureSubsetStrategy() == "0.5"
    assert trees.forest(max_depth=50).getMaxDepth() == 30


def test_adaboost_perfect_learner_stops(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2) * 10) for i in range(40)], "x double, y double")
    df = assemble(df, ["x"])
    m = trees.adaboost_r2(df, "features", "y", n_estimators=10, max_depth=2)
    assert len(m.trees) == 1
    preds = [r.prediction for r in m.transform(df).collect()]
    assert preds[:2] == [0.0, 10.0]


def test_adaboost_weighted_median(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 10, 300)
    df = assemble(spark.createDataFrame([(float(a), float(np.sin(a) * 5 + a)) for a in x], "x double, y double"), ["x"])
    m = trees.adaboost_r2(df, "features", "y", n_estimators=5, max_depth=3, loss="square")
    assert 1 <= len(m.trees) <= 5
    rmse = np.sqrt(np.mean([(r.prediction - r.y) ** 2 for r in m.transform(df).collect()]))
    assert rmse < 2.5


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["Id", "HotelValue"] and len(rows) > 0
    assert all(r.HotelValue >= 0 for r in rows)
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60


def test_gbt_validation_curve(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 5, 400)
    df = assemble(spark.createDataFrame([(float(a), float(2 * a + rng.normal())) for a in x], "x double, y double"), ["x"])
    m = trees.boosted(label="y", n_trees=4, max_depth=2).fit(df)
    curve = trees.validation_curve(m, df, "y")
    assert len(curve) == 4 and curve[-1] < curve[0]
    assert trees.best_iteration(m, df, "y") == int(np.argmin(curve)) + 1


def test_knn_blocks_settle_ties_and_skip_far_blocks(spark):
    """Many equal distances, several blocks, both metrics, string keys."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 4, (300, 3)), rng.integers(0, 4, (60, 3)) + 1000]).astype(float)
    rows = [(f"k{i:04d}", [float(v) for v in r], float(i % 7)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, v array<double>, y double")
    for metric in ("euclidean", "manhattan"):
        got = knn.knn_neighbours(df, df, "id", "v", "y", 6, metric, chunk_bytes=40 * 40)
        have = {}
        for r in got.collect():
            have.setdefault(r["id"], []).append((r["nb_rank"], r["nb_key"], r["dist"], r["nb_label"]))
        for i, (name, v, _) in enumerate(rows):
            diff = x - np.array(v)
            dist = np.abs(diff).sum(axis=1) if metric == "manhattan" else np.sqrt((diff ** 2).sum(axis=1))
            want = sorted((d, rows[j][0], rows[j][2]) for j, d in enumerate(dist))[:6]
            assert [(d, k, y) for _, k, d, y in sorted(have[name])] == want


@pytest.mark.parametrize("kind", ["spread", "copies", "outlier", "missing"])
def test_knn_whole_steps_keep_the_nearest(kind):
    """Manhattan candidates found by whole numbers of steps: within the margin of the
    distances, and the nearest are those of plain subtraction."""
    import pyarrow as pa
    rng = np.random.default_rng(6)
    x, b = rng.normal(size=(40, 9)), rng.normal(size=(900, 9))
    if kind == "copies":
        x, b = np.round(x / 2), np.round(b / 2)
    if kind == "outlier":
        b[3, 2] = 1e9
    if kind == "missing":
        b[5, 1] = np.nan
    whole = knn._whole(x, b)
    if kind == "missing":  # left to the plain sums
        assert whole is None
        return
    dist = np.abs(x[:, None] - b[None]).sum(axis=2)
    qx, qb, step = whole
    assert (np.abs(knn._steps_apart(qx, qb) * step - dist) <= 9 * step * (1 + 1e-6)).all()
    held = knn._Nearest(pa.array(np.arange(40)), x, 7, "manhattan")
    for at in range(0, 900, 300):
        part = b[at:at + 300]
        held.meet(np.arange(at, at + 300), part, np.zeros(300), np.zeros(9), float("inf"))
    for q in range(40):
        want = sorted((d, j) for j, d in enumerate(dist[q]))[:7]
        assert [j for _, j in want] == held.base[held.row == q].tolist()
        assert np.allclose([d for d, _ in want], held.dist[held.row == q], rtol=1e-12)
