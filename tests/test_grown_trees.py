"""Forests by two-phase growth and second-order boosting against plain versions."""
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from valora.operators import boosting, forest
from valora.operators.boosting import Boost
from valora.operators.forest import Candidate, Growth


def sample(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 5, n), rng.integers(0, 30, n)]).astype(float)
    y = np.round(3 * x[:, 0] - 2 * (x[:, 1] > 2) * x[:, 2] + rng.normal(size=n), 3)
    return x, y


def frame(spark, x, y, folds=3):
    rows = [(i, [float(v) for v in r], float(t), i % folds, int(i % 5 == 0)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "Id long, x array<double>, label double, fold int, held int")
    return df.withColumn("features", array_to_vector("x")).repartition(3)


def brute_tree(x, y, w, limits, depth=0):
    """Nested (feature, threshold, left, right) or a value."""
    mean = float(np.average(y, weights=w))
    if (limits.max_depth is not None and depth >= limits.max_depth) or len(set(y)) == 1 or len(y) < max(limits.min_split, 2 * limits.min_leaf):
        return mean
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for a, b in zip(values, values[1:], strict=False):
            go = x[:, f] <= a
            if min(go.sum(), (~go).sum()) < limits.min_leaf:
                continue
            gain = sum(w[s].sum() * (np.average(y[s], weights=w[s]) - mean) ** 2 for s in (go, ~go))
            if best is None or gain > best[0] + 1e-9 * abs(gain):
                best = gain, f, (a + b) / 2, go
    if best is None:
        return mean
    _, f, cut, go = best
    return f, cut, brute_tree(x[go], y[go], w[go], limits, depth + 1), brute_tree(x[~go], y[~go], w[~go], limits, depth + 1)


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return float(tree.value[node])
    return int(tree.feature[node]), float(tree.threshold[node]), nested(tree, tree.left[node]), nested(tree, tree.left[node] + 1)


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a[0] == b[0] and math.isclose(a[1], b[1]) and same(a[2], b[2]) and same(a[3], b[3])


@pytest.mark.parametrize("limits", [Growth(), Growth(3), Growth(None, 5), Growth(6, 1, 12), Growth(0)])
def test_a_tree_is_that_of_plain_recursion(limits):
    x, y = sample()
    w = forest.bootstrap(np.arange(len(y)), 3, 42)
    have = w > 0
    got = forest.grow(x[have], y[have], w[have], limits, 1)
    assert same(nested(got), brute_tree(x[have], y[have], w[have], limits))


def test_levels_and_trees_are_prefixes():
    x, y = sample()
    w = np.ones(len(y))
    full = forest.grow(x, y, w, Growth(max_features=2), 5)
    for d in (0, 1, 4):
        short = forest.grow(x, y, w, Growth(d, max_features=2), 5)
        assert np.allclose(full.walk(x, [d])[0][0], short.walk(x)[0][0])
    back = forest.Tree.loads(full.dumps())
    assert all((getattr(back, n) == getattr(full, n)).all() for n in ("feature", "threshold", "left", "value", "path"))


def test_missing_values_go_right_and_extremes_split():
    x = np.array([[np.nan], [1.0], [2.0], [np.inf], [-np.inf]])
    y = np.array([9.0, 1.0, 2.0, 3.0, 0.0])
    got = forest.grow(x, y, np.ones(5), Growth(), 1)
    assert np.isfinite(got.value).all() and got.walk(x)[0][0][4] == 0.0 and got.walk(x)[0][0][1] == 1.0


@pytest.mark.parametrize("limits", [Growth(resample=False), Growth(5, 3, 2, 2, False)])
def test_two_phases_give_the_trees_of_one(spark, limits):
    """Bins hold every distinct value here, so the cluster's splits part a node's rows alike."""
    x, y = sample()
    df = frame(spark, x, y)
    args = dict(key="Id", n_trees=4, limits=limits, seed=7)
    one = forest.fit_forest(df, **args)
    two = forest.fit_forest(df, **args, node_rows=25, bins=256, broadcast_bytes=0)
    a, b = (sorted((r["Id"], r["prediction"]) for r in m.transform(df).collect()) for m in (one, two))
    assert np.allclose([v for _, v in a], [v for _, v in b])
    assert sum(len(g) for g in two.groups()) == 4
    assert one.transform(df.limit(0)).count() == 0


def test_forest_is_the_mean_of_its_trees_and_ignores_partitions(spark):
    x, y = sample()
    df = frame(spark, x, y)
    model = forest.fit_forest(df, key="Id", n_trees=3, limits=Growth(4))
    again = forest.fit_forest(df.repartition(7), key="Id", n_trees=3, limits=Growth(4))
    key = np.array([r["k"] for r in df.orderBy("Id").select(F.xxhash64("Id").alias("k")).collect()])
    want = np.zeros(len(y))
    for t in range(3):
        w = forest.bootstrap(key, t, 42)
        s = w > 0
        tree = forest.grow(x[s], y[s], w[s], Growth(4), int(forest._salted(42, t)))
        want += tree.walk(x)[0][0] / 3
    for m in (model, again):
        got = [r["prediction"] for r in m.transform(df).orderBy("Id").collect()]
        assert np.allclose(got, want)


def test_forest_search_scores_prefixes_of_shared_forests(spark):
    x, y = sample()
    df = frame(spark, x, y)
    cands = [Candidate(n, Growth(d, leaf)) for n in (3, 12) for d in (None, 2) for leaf in (1, 4)]
    quick = forest.cross_validate(df, cands, "fold", 3, key="Id")
    slow = forest.cross_validate(df, cands, "fold", 3, key="Id", broadcast_bytes=0)
    assert np.allclose(quick, slow)
    # rows outside a tree's sample may fall between an edge and the middle of two values
    binned = forest.cross_validate(df, cands[:4], "fold", 3, key="Id", node_rows=40, broadcast_bytes=0)
    assert np.allclose(quick[:4], binned, rtol=0.1)
    errors = []
    for f in range(3):
        m = forest.fit_forest(df.where(F.col("fold") != f), key="Id", n_trees=12, limits=Growth(2, 4))
        e = m.transform(df.where(F.col("fold") == f)).select(F.avg((F.col("prediction") - F.col("label")) ** 2)).first()[0]
        errors.append(math.sqrt(e))
    assert math.isclose(quick[7], np.mean(errors), rel_tol=1e-9)
    with pytest.raises(ValueError):
        forest.cross_validate(df, cands, "fold", 4, key="Id")


# ------------------------------------------------------------------- boosting
def brute_boost(x, y, b):
    """Predictions after each round; exact splits, penalties as in the definition."""
    soft = lambda g: math.copysign(max(abs(g) - b.l1, 0.0), g)
    score = lambda g, h: soft(g) ** 2 / (h + b.l2)
    p = np.full(len(y), y.mean())
    out = []

    def grow(rows, g, depth):
        total = score(g[rows].sum(), len(rows))
        best = None
        for f in range(x.shape[1]) if b.max_depth is None or depth < b.max_depth else ():
            for a in np.unique(x[rows, f])[:-1]:
                go = x[rows, f] <= a
                if min(go.sum(), (~go).sum()) < b.min_child:
                    continue
                gain = score(g[rows[go]].sum(), go.sum()) + score(g[rows[~go]].sum(), (~go).sum()) - total
                if gain > max(b.gamma, 1e-6) and (best is None or gain > best[0] + 1e-9):
                    best = gain, go
        if best is None:
            p[rows] += b.rate * -soft(g[rows].sum()) / (len(rows) + b.l2)
        else:
            grow(rows[best[1]], g, depth + 1)
            grow(rows[~best[1]], g, depth + 1)

    for _ in range(b.n_trees):
        grow(np.arange(len(y)), p - y, 0)
        out.append(p.copy())
    return out


@pytest.mark.parametrize("b", [Boost(3, 0.3, 3), Boost(3, 0.5, 2, l1=4.0, l2=3.0, gamma=50.0, min_child=9), Boost(3, 1.0, 1, l2=0.0)])
def test_boosting_against_plain_rounds(spark, b):
    x, y = sample()
    df = frame(spark, x, y)
    want = brute_boost(x, y, b)
    for model in (boosting.fit_boosted(df, b, key="Id", bins=256), boosting.fit_boosted(df, b, key="Id", bins=256, broadcast_bytes=0)):
        for k in range(1, 4):
            assert np.allclose(model.first(k).predict(x), want[k - 1])
    got = [r["prediction"] for r in model.transform(df).orderBy("Id").collect()]
    assert np.allclose(got, want[-1])


def test_sources_give_the_same_trees_with_drawn_rows_and_columns(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STAGE_TREES", 2)
    x, y = sample()
    df = frame(spark, x, y)
    b = Boost(5, 0.3, 4, subsample=0.7, colsample=0.6, l1=0.1, seed=3)
    one, two = (boosting.fit_boosted(df, b, key="Id", valid_col="held", broadcast_bytes=n) for n in (1 << 26, 0))
    assert np.allclose(one.curve, two.curve) and len(one.curve) == 5
    assert np.allclose(one.predict(x), two.predict(x))
    assert len({tuple(b.columns(10, t)) for t in range(20)}) > 5
    held = [i for i in range(len(y)) if i % 5 == 0]
    assert math.isclose(one.curve[-1], np.mean((one.predict(x[held]) - y[held]) ** 2))


def arrays(x, bins=256):
    edges = np.stack([np.quantile(x[:, f], np.arange(1, bins) / bins, method="inverted_cdf") for f in range(x.shape[1])])
    return np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(x.shape[1])], axis=1).astype(np.uint8), edges


def test_leaves_grow_in_order_of_gain():
    x, y = sample()
    codes, edges = arrays(x)
    def fit(depth, leaves):
        b = Boost(1, 1.0, depth, max_leaves=leaves, l2=0.0)
        return boosting.fit_arrays(np.arange(len(y)), codes, y, np.zeros(len(y), bool), edges, b)
    full = fit(None, 12).trees[0]
    sse = []
    for leaves in range(2, 13):
        m = fit(None, leaves)
        tree = m.trees[0]
        assert (tree.feature < 0).sum() == leaves
        inner = tree.feature >= 0  # the first splits are those of the largest tree
        assert (full.left[:len(inner)][inner] == tree.left[inner]).all()
        sse.append(np.sum((m.predict(x) - y) ** 2))
    assert (np.diff(sse) < 0).all()
    # of two leaves the one with the larger gain is split: no other tree of three leaves and this root is better
    root = full.feature[0], full.threshold[0]
    two = fit(2, None).trees[0]
    assert (two.feature[0], two.threshold[0]) == root
    by_side = []
    for child in (1, 2):
        only = np.where(np.arange(len(two.feature)) == 3 - child, -1, two.feature)
        cut = forest.Tree(only, two.threshold, two.left, two.value, two.path)
        by_side.append(np.sum((y.mean() + cut.walk(x)[0][0] - y) ** 2))
    assert math.isclose(min(by_side), sse[1])


def test_patience_keeps_the_best_prefix_of_one_fit(spark, monkeypatch):
    monkeypatch.setattr(boosting, "STAGE_TREES", 4)
    x, _ = sample()
    df = frame(spark, x, np.random.default_rng(1).normal(size=len(x)))
    long = boosting.fit_boosted(df, Boost(30, 0.5, 2), key="Id", valid_col="held")
    stop = boosting.fit_boosted(df, Boost(30, 0.5, 2, patience=3), key="Id", valid_col="held")
    far = boosting.fit_boosted(df, Boost(30, 0.5, 2, patience=3), key="Id", valid_col="held", broadcast_bytes=0)
    assert len(stop.trees) == stop.best_iteration + 3 < 30
    assert np.allclose(stop.curve, long.curve[:len(stop.curve)]) and np.allclose(stop.curve, far.curve)


@pytest.mark.parametrize("b", [Boost(9, 0.3, 3), Boost(9, 0.3, 3, subsample=0.6, colsample=0.7), Boost(9, 0.3, None, 5), Boost(40, 0.5, 2, patience=3)])
def test_cluster_boosting_reads_the_staged_rows_once(spark, monkeypatch, b):
    """The passes of all trees read kept blocks; nothing is staged again and old checkpoints go."""
    monkeypatch.setattr(boosting, "KEPT_TREES", 2)
    monkeypatch.setattr(boosting, "STAGE_TREES", 4)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 30, (600, 4)).astype(float)
    df = frame(spark, x, x[:, 0] * x[:, 1] + rng.normal(size=600)).withColumn(
        "held", F.when(F.col("Id") % 7 != 0, (F.col("Id") % 5 == 0).cast("int")))
    one = boosting.fit_boosted(df, b, key="Id", valid_col="held")
    staged, kept = [], set(spark.sparkContext._jsc.getPersistentRDDs())
    real = boosting.stage_table
    monkeypatch.setattr(boosting, "stage_table", lambda rows, name: (staged.append(name), real(rows, name))[1])
    two = boosting.fit_boosted(df, b, key="Id", valid_col="held", broadcast_bytes=0)
    assert staged == ["boost-rows", "boost-codes"]
    assert len(one.trees) == len(two.trees) and np.allclose(one.curve, two.curve)
    assert np.allclose(one.predict(x), two.predict(x))
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept


def test_boosting_search_reads_every_count_off_one_fit(spark, monkeypatch):
    x, y = sample()
    df = frame(spark, x, y)
    fits = []
    real = boosting.fit_side_by_side
    monkeypatch.setattr(boosting, "fit_side_by_side", lambda rows, edges, jobs, n: (fits.extend(jobs), real(rows, edges, jobs, n))[1])
    cands = [Boost(n, 0.3, d) for n in (2, 7) for d in (1, 3)]
    got = boosting.cross_validate(df, cands, "fold", 3, key="Id")
    assert len(fits) == 6 and got[2] < got[0] and got[3] < got[1]
    folds = [boosting.fit_boosted(df.withColumn("v", (F.col("fold") == f).cast("int")), Boost(2, 0.3, 1), key="Id", valid_col="v").curve[1] for f in range(3)]
    assert math.isclose(got[0], np.mean(np.sqrt(folds)), rel_tol=1e-9)


# ------------------------------------------------------------------- AdaBoost
def brute_ada(x, y, a):
    w, trees, betas = np.ones(len(y)), [], []
    for _ in range(a.n_estimators):
        tree = forest.grow(x, y, w, Growth(a.max_depth), 1)
        e = np.abs(tree.walk(x)[0][0] - y)
        if e.max() <= 1e-12:
            trees, betas = trees + [tree], betas + [1.0]
            break
        lost = {"linear": lambda v: v, "square": lambda v: v ** 2, "exponential": lambda v: 1 - np.exp(-v)}[a.loss](e / e.max())
        mean = np.sum(lost * w) / np.sum(w)
        if mean >= 0.5:
            break
        beta = mean / (1 - mean)
        trees, betas = trees + [tree], betas + [a.learning_rate * np.log(1 / beta)]
        w = w * beta ** ((1 - lost) * a.learning_rate)
        w /= w.mean()
    return trees, betas


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_adaboost_against_plain_rounds(spark, monkeypatch, loss):
    from valora.operators import adaboost
    monkeypatch.setattr(boosting, "STAGE_TREES", 2)
    x, y = sample()
    df = frame(spark, x, y)
    a = adaboost.Ada(3, 0.7, loss, 2)
    trees, betas = brute_ada(x, y, a)
    for bound in (1 << 26, 0) if loss == "square" else (1 << 26,):
        m = adaboost.fit_adaboost(df, a, key="Id", bins=256, broadcast_bytes=bound)
        assert np.allclose(m.weights, betas)
        assert all(np.allclose(t.walk(x)[0][0], u.walk(x)[0][0]) for t, u in zip(m.trees, trees, strict=True))
    got = np.array([r["prediction"] for r in m.transform(df).orderBy("Id").collect()])
    p = np.stack([t.walk(x)[0][0] for t in trees], axis=1)
    for i in range(0, len(y), 7):
        order = np.argsort(p[i], kind="stable")
        upto = np.cumsum(np.array(betas)[order])
        assert math.isclose(got[i], p[i][order[np.argmax(upto >= upto[-1] / 2)]])


def test_adaboost_search_and_a_perfect_learner(spark):
    from valora.operators import adaboost
    x, y = sample(120)
    df = frame(spark, x, y)
    cands = [adaboost.Ada(n, 1.0, "linear", 3) for n in (1, 4)]
    near = adaboost.cross_validate(df, cands, "fold", 3, key="Id")
    assert np.allclose(near, adaboost.cross_validate(df, cands, "fold", 3, key="Id", broadcast_bytes=0))
    perfect = adaboost.fit_adaboost(frame(spark, x, 1.0 + (x[:, 0] > 5)), adaboost.Ada(10), key="Id")
    assert len(perfect.trees) == 1 and perfect.weights == [1.0]
    with pytest.raises(ValueError):
        adaboost.Ada(loss="other")


def test_a_forest_grown_on_the_cluster_scores_without_its_trees_on_the_driver(spark, monkeypatch):
    """Rows go to the subtrees: no tree is spliced, collected or broadcast."""
    def never(*_):
        raise AssertionError("trees on the driver")
    x, y = sample()
    df = frame(spark, x, y)
    cands = [Candidate(n, Growth(d)) for n in (2, 5) for d in (None, 1, 4)]
    scores = forest.cross_validate(df, cands, "fold", 3, key="Id")
    model = forest.fit_forest(df, key="Id", n_trees=5, node_rows=25, broadcast_bytes=0)
    want = np.mean([t.walk(x)[0][0] for group in model.groups() for t in group], axis=0)
    monkeypatch.setattr(forest.ForestModel, "groups", never)
    got = model.transform(df)
    assert got.columns == [*df.columns, "prediction"]
    assert np.allclose([r["prediction"] for r in got.orderBy("Id").collect()], want)
    assert np.allclose(forest.cross_validate(df, cands, "fold", 3, key="Id", broadcast_bytes=0), scores)


def test_ranks_give_the_rows_back_and_sparse_cells_the_sums_of_dense_ones():
    x = np.array([[2.0, np.nan], [1.0, 7.0], [2.0, np.nan]])
    codes, values = forest.ranked(x)
    assert codes.dtype == np.uint8 and codes.tolist() == [[1, 0, 1], [1, 0, 1]]
    assert np.array_equal(forest.unranked(codes, values), x, equal_nan=True)
    cell, w = np.array([5, 2, 5, 9]), np.array([1.0, 2.0, 3.0, 4.0])
    for cells in (10, 10_000):
        have, (s, n) = forest._present(cell, cells, [w, None])
        assert have.tolist() == [2, 5, 9] and s.tolist() == [2.0, 4.0, 4.0] and n.tolist() == [1, 2, 1]


@pytest.mark.parametrize("limits", [Growth(resample=False), Growth(5, 3, 2, 2)])
def test_a_large_table_of_few_values_hands_no_rows_to_nodes(spark, monkeypatch, limits):
    """Its ranks are broadcast: whole trees, and only summed predictions are sent, in pieces."""
    def never(*_):
        raise AssertionError("rows dealt to nodes")
    x, y = sample()
    x[::7, 1] = np.nan
    df = frame(spark, x, y)
    one = forest.fit_forest(df, key="Id", n_trees=3, limits=limits)
    cands = [Candidate(n, Growth(d, leaf)) for n in (2, 5) for d in (None, 2) for leaf in (1, 4)]
    want = forest.cross_validate(df, cands, "fold", 3, key="Id")
    monkeypatch.setattr(forest, "_top_levels", never)
    monkeypatch.setattr(forest, "SUMS_ROWS", 16)
    monkeypatch.setattr(forest, "SUMS_BYTES", 0)
    two = forest.fit_forest(df, key="Id", n_trees=3, limits=limits, node_rows=25)
    a, b = ([r["prediction"] for r in m.transform(df).orderBy("Id").collect()] for m in (one, two))
    assert a == b
    assert np.allclose(want, forest.cross_validate(df, cands, "fold", 3, key="Id", node_rows=25), rtol=1e-12)


def test_ranks_are_those_of_the_table_or_none(spark, monkeypatch):
    x, y = sample(60)
    x[:9, 2] = np.nan
    rows = forest._rows(frame(spark, x, y), "features", "label", "Id")
    values = forest.distinct_values(rows, 3)
    assert all(np.array_equal(v, np.unique(c), equal_nan=True) for v, c in zip(values, x.T, strict=True))
    assert forest.distinct_values(rows, 3, most=6) is None and forest._held(rows, 60, 3, 10, 60) is None
    small, large = (forest._held(rows, 60, 3, n, 1 << 20) for n in (60, 10))
    assert all(np.array_equal(a, b) for i in (0, 1, 3) for a, b in [(small[i], large[i])])
    tree = forest.grow_ranked(small[1], small[2], small[3], np.ones(60), Growth(4), 1)
    back = forest.unranked(small[1], small[2])
    assert np.array_equal(forest.walk_ranks(forest.Tree.loads(tree.dumps()), small[1], small[2], [None, 0, 2, 9]), tree.walk(back, [None, 0, 2, 9])[0])


@pytest.mark.parametrize("b", [Boost(2, 0.5, None, 16, l2=0.0, min_child=3), Boost(2, 0.5, 4, 12, gamma=20.0)])
def test_leaves_grow_on_the_cluster_in_few_passes(spark, monkeypatch, b):
    """All leaves that would be split are parted in one pass; the tree is that of one leaf a pass."""
    passes = []
    real = boosting.gathered
    monkeypatch.setattr(boosting, "gathered", lambda parts, *a: (passes.append(1), real(parts, *a))[1])
    x, y = sample(400)
    df = frame(spark, x, y)
    one, two = (boosting.fit_boosted(df, b, key="Id", broadcast_bytes=n) for n in (1 << 26, 0))
    for s, t in zip(one.trees, two.trees, strict=True):
        assert (s.feature == t.feature).all() and (s.left == t.left).all() and np.allclose(s.value, t.value) and np.allclose(s.threshold, t.threshold)
    assert len(one.trees[0].feature) > 15 and len(passes) <= 2 * 9


def test_columns_counted_together_give_the_sums_of_single_ones(monkeypatch):
    rng = np.random.default_rng(3)
    edges = np.sort(rng.integers(0, 5, (4, 15)), axis=1).astype(float)  # equal edges: codes that no row has
    present = boosting.present_codes(edges)
    at = np.stack([rng.integers(0, len(c), 900) for c in present]).astype(np.uint8)
    slot, g, h = rng.integers(0, 3, 900), rng.normal(size=900), rng.random(900)
    use, columns = np.flatnonzero(rng.random(900) < 0.7), np.array([0, 2, 3])
    want = np.zeros((3, 2, 3, 16))
    for i, f in enumerate(columns):
        np.add.at(want, (slot[use], 0, i, present[f][at[f, use]]), g[use])
        np.add.at(want, (slot[use], 1, i, present[f][at[f, use]]), h[use])
    for cells in (1 << 16, 60, 1):
        monkeypatch.setattr(boosting, "JOINT_CELLS", cells)
        c = boosting.Cells(3, columns, present, 16)
        c.add(at, slot[use], use, g[use], h[use])
        assert len(c.groups) == (1 if cells > 1000 else 3 if cells == 1 else len(c.groups)) and np.allclose(c.histograms(), want)


@pytest.mark.parametrize("loss", ["linear", "exponential"])
def test_cluster_adaboost_keeps_its_weights_and_stages_nothing(spark, monkeypatch, loss):
    from valora import session
    from valora.operators import adaboost
    monkeypatch.setattr(boosting, "STAGE_TREES", 3)
    x, y = sample()
    df = frame(spark, x, y)
    a = adaboost.Ada(7, 0.8, loss, 2)
    one = adaboost.fit_adaboost(df, a, key="Id")
    staged, kept = [], set(spark.sparkContext._jsc.getPersistentRDDs())
    real = session.owned_path
    monkeypatch.setattr(session, "owned_path", lambda spark, prefix: (staged.append(prefix), real(spark, prefix))[1])
    two = adaboost.fit_adaboost(df, a, key="Id", broadcast_bytes=0)
    assert set(staged) == {"boost-rows", "boost-codes"}
    assert np.allclose(one.weights, two.weights) and np.allclose(one.predict(x), two.predict(x)) and len(two.trees) == 7
    assert set(spark.sparkContext._jsc.getPersistentRDDs()) <= kept
