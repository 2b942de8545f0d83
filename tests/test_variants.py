"""The pipeline variants (config-table rows) end to end on the smallest
driver tables: every row type runs, predictions are complete and >= 0."""
import pytest

from valora.operators import folds
from valora.plans.variants import VARIANTS, run_variant
from valora.plans.workflow import property_table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def split(spark):
    t = folds.split(property_table(spark, SF), "Id", 0.15).cache()
    return t.where("is_test = 0").drop("is_test"), t.where("is_test = 1").drop("is_test", "HotelValue")


@pytest.mark.parametrize("name", ["F3", "CP", "NB_LASSO", "LOO", "NOLOG"])
def test_linear_variants(split, name):
    tr, sc = split
    out, rep = run_variant(tr, sc, name)
    rows = out.collect()
    assert len(rows) == sc.count() and all(r.HotelValue >= 0 for r in rows)
    assert rep["n_features"] > 0


def test_config_table_rows_are_complete():
    for name, cfg in VARIANTS.items():
        assert cfg["rule"] in ("a", "b", "c") and "model" in cfg, name


def test_searches_use_the_reference_spaces(split, monkeypatch):
    """Draws, folds and spaces that each row searches; the fits are replaced by small ones."""
    from valora.operators import maps
    from valora.plans import variants
    tr, sc = split
    small = {"forest_grid": {"numTrees": 2, "maxDepth": 2, "minInstancesPerNode": 1},
             "gbt_search": {"n_estimators": 2, "learning_rate": 0.1, "max_depth": 2, "subsample": 1.0, "colsample": None},
             "adaboost_search": {"n_estimators": 2, "max_depth": 2}}
    small["forest_search"] = small["forest_grid"]
    for name, n, k, space in (("RFG", 8, 3, maps.FOREST_GRID), ("RFB", 20, 3, maps.FOREST_SAMPLED_SPACE),
                              ("XGA", 30, 3, maps.BOOSTED_SPACE), ("ADA", 30, 5, maps.ADABOOST_SPACE)):
        seen = []
        model = VARIANTS[name]["model"]
        row = variants._TREES[model]

        def cv(df, make, folds_, seed, seen=seen, k=k):
            assert folds_ == k and {r[0] for r in df.select("__fold").distinct().collect()} == set(range(k))
            return lambda cands: (seen.extend(cands), [float(i) for i in range(len(cands))])[1]

        monkeypatch.setitem(variants._TREES, model, {**row, "cv": cv, "make": lambda c, s, r=row, m=model: r["make"](small[m], s)})
        out, rep = run_variant(tr, sc, name)
        assert len(seen) == n and len(rep["cv_rmse"]) == n and rep["chosen"] in ("baseline", "tuned")
        assert ("valid_rmse" in rep) == (name in ("RFG", "RFB"))
        for c in seen:
            for key, spec in space.items():
                if isinstance(spec, list):
                    assert c[key] in spec
                else:
                    assert c[key] in spec[1] if spec[0] == "choice" else spec[1] <= c[key] <= spec[2]
        rows = out.collect()
        assert len(rows) == sc.count() and all(r.HotelValue >= 0 for r in rows)
    assert VARIANTS["KNN"]["pca"] == [50, 100, 0.95, 0.99]


def test_tree_cross_validation_scores_each_candidate(split):
    from valora.plans import variants
    ytr, _, feats, _, _ = variants._prepare(*split, VARIANTS["RFB"], "Id", "HotelValue")
    df = (variants.preprocess.assemble(ytr, feats).withColumn("__fold", variants.hash_bucket("Id", 2))
          .withColumn("__key", variants.F.col("Id")).cache())
    forests = [{"numTrees": 2, "maxDepth": d, "minInstancesPerNode": 1, "featureSubsetStrategy": 0.5} for d in (1, 6)]
    a, b = variants._forest_cv(df, None, 2, 42)(forests)
    assert a > 0 and b > 0 and a != b
    boosts = [{"n_estimators": n, "max_depth": 2} for n in (1, 3)]
    got = variants._adaboosted_cv(df, None, 2, 42)(boosts)
    assert len(got) == 2 and all(x > 0 for x in got)
    more = [{"n_estimators": n, "learning_rate": 0.3, "max_depth": 2, "subsample": 0.8, "colsample": 0.8, "l1": 0.1, "l2": 1.0} for n in (1, 9)]
    got = variants._boosted_cv(df, None, 2, 42)(more)
    assert min(got) > 0 and got[0] != got[1]


def test_elastic_net_path_has_100_alphas(spark):
    from valora.plans.catalog import QUERIES
    got = QUERIES["elastic_net_cv"](spark, SF).groupBy("l1_ratio", "fold").count().collect()
    assert len(got) == 35 and {r["count"] for r in got} == {100}
