"""The reference's pipeline variants as rows of a config
table run by one function - not as separate operators.

Each row picks: the outlier rule (a/b/c), the feature configuration of
``features.engineer``, the target transform, the encoder (one-hot + scaling
or ordinal codes), optional polynomial expansion / targeted imputation, the
model family with its search, and how the winner is chosen."""

from __future__ import annotations

from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import hash_bucket
from ..operators import (
    adaboost, boosting, clean, features, folds, forest, linear, maps, metrics, preprocess, search, selection,
)
from ..session import ensure_parallelism

_L1_EXTRA = {"log_list": "L1", "interaction": True, "bath_count": True}

VARIANTS = {
    # linear family: one statistics pass, every candidate x fold from it
    "F1": {"rule": "b", "features": _L1_EXTRA, "model": "ridge_search", "n_iter": 30},
    "F2": {"rule": "b", "features": {"log_list": "L3"}, "model": "ridge_search", "n_iter": 30},
    "F3": {"rule": "c", "features": {"log_list": "L2"}, "model": "ridge_search", "n_iter": 30},
    "NOLOG": {"rule": "c", "features": {"log_list": "L2"}, "target": "identity", "model": "ridge_search"},
    "GRID": {"rule": "b", "features": _L1_EXTRA, "model": "ridge_grid"},
    "LOO": {"rule": "b", "features": _L1_EXTRA, "model": "loo"},
    "CP": {"rule": "b", "features": {"log_list": "L2"}, "model": "bayes", "max_iter": 300},
    "NB_LASSO": {"rule": "a", "features": {"log_list": "L1", "interaction": True}, "model": "lasso_cv"},
    "NB_ENET": {"rule": "a", "features": {"log_list": "L1", "interaction": True}, "model": "enet_cv"},
    "NB_POLY_LASSO": {"rule": "a", "features": {"log_list": "L1", "interaction": True, "bath_count": True},
                      "poly": 2, "model": "lasso_cv"},
    "NB_TARGETED": {"rule": "a", "features": {"log_list": "L1", "interaction": True},
                    "impute": "targeted", "model": "ridge_search", "n_iter": 20},
    "NB_K4": {"rule": "a", "features": {"log_list": "L1"}, "model": "ridge_search", "n_iter": 20, "k": 4},
    "NB_K6": {"rule": "a", "features": {"log_list": "L1"}, "model": "ridge_search", "n_iter": 20, "k": 6},
    # neighbours on principal components
    "KNN": {"rule": "b", "features": {"log_list": "L2"}, "model": "knn", "pca": maps.KNN_PCA_COMPONENTS},
    # trees on ordinal codes, unscaled
    "RFG": {"rule": "b", "features": {"log_list": "L1", "tree_extra_maps": True}, "encoder": "ordinal",
            "model": "forest_grid"},
    "RFB": {"rule": "b", "features": {"log_list": "L1", "tree_extra_maps": True}, "encoder": "ordinal",
            "model": "forest_search", "n_iter": 20},
    "XGA": {"rule": "b", "features": {"log_list": "L1", "tree_extra_maps": True}, "encoder": "ordinal",
            "model": "gbt_search", "n_iter": 30, "k": 3},
    "ADA": {"rule": "c", "features": {"log_list": "L2"}, "encoder": "ordinal", "scale": True,
            "model": "adaboost_search", "n_iter": 30, "k": 5},
}


def _fit_pipeline(train: DataFrame, score: DataFrame, cfg: dict, key: str, target: str):
    """(training rows, scoring rows, fitted preprocessing) of a config."""
    rule = clean.exclusion_rule(cfg["rule"])
    tr = clean.clean_rows(train, target, maps.TARGET_TRIM, "UsableArea", maps.USABLE_AREA_CAP, rule)
    fcfg = dict(cfg.get("features", {}))
    tr, sc = features.engineer(tr, fcfg), features.engineer(score, fcfg)
    num, cat = clean.columns_by_role(tr, exclude=[key, target])
    zero = [c for c in maps.ZERO_IMPUTE_COLUMNS if c in num] if cfg.get("impute") == "targeted" else []
    pipe = preprocess.build_pipeline(num, cat, zero=zero, scale=cfg.get("scale", cfg.get("encoder") != "ordinal"),
                                     encoder=cfg.get("encoder", "onehot"), poly_degree=cfg.get("poly")).fit(tr)
    return tr, sc, pipe


def _labelled(t: DataFrame, cfg: dict, key: str, target: str) -> DataFrame:
    return (t.withColumn("__y", features.target_forward(target, cfg.get("target", "log1p")))
            .withColumn("__fold", hash_bucket(key, int(cfg.get("k", 5)))))


def _prepare(train: DataFrame, score: DataFrame, cfg: dict, key: str, target: str):
    return _prepared(*_fit_pipeline(train, score, cfg, key, target), cfg, key, target)


def _prepared(tr: DataFrame, sc: DataFrame, pipe, cfg: dict, key: str, target: str):
    feats = preprocess.feature_columns(pipe)
    scaled = {c for st in pipe.stages if isinstance(st, preprocess.StandardizeModel) for c in st.mean}
    ytr = _labelled(pipe.transform(tr), cfg, key, target)
    return ytr, pipe.transform(sc), feats, [c in scaled for c in feats], cfg.get("target", "log1p")


def _linear_out(model, sc, key, target, kind):
    return (model.transform(sc, "__p")
            .select(key, F.greatest(features.target_inverse("__p", kind), F.lit(0.0)).alias(target)))


def _train_rmse(ytr, models: dict, target, kind):
    """Original-scale training RMSE of several linear models in ONE pass."""
    cols = []
    for name, m in models.items():
        p = F.greatest(features.target_inverse(m.predict_col(), kind), F.lit(0.0))
        cols.append(F.struct(F.lit(name).alias("model"), p.alias("p")))
    long = ytr.select(target, F.explode(F.array(*cols)).alias("m")).select(target, "m.model", "m.p")
    return {r["model"]: r["rmse"] for r in metrics.regression_metrics(long, target, "p", by=["model"]).collect()}


def _choose(scores: dict, tuned: str = "tuned", base: str = "baseline") -> str:
    return tuned if scores[tuned] < scores[base] else base  # tie -> baseline


def run_variant(train: DataFrame, score: DataFrame, cfg: dict | str, key: str = "Id",
                target: str = "HotelValue", seed: int = 42):
    """Run one config row; returns (predictions ``key, target``, report)."""
    cfg = VARIANTS[cfg] if isinstance(cfg, str) else cfg
    model = cfg["model"]
    if model in ("knn", "forest_grid", "forest_search", "gbt_search", "adaboost_search"):
        return _run_ml(train, score, cfg, key, target, seed)
    tr, raw, pipe = _fit_pipeline(train, score, cfg, key, target)
    ytr, sc, feats, mask, kind = _prepared(tr, raw, pipe, cfg, key, target)
    rows, indicators, products = preprocess.compact(pipe, tr)  # no column a level or product
    rows = _labelled(rows, cfg, key, target)
    g = linear.gram(rows, feats, "__y", fold_col="__fold", indicators=indicators, products=products)
    report = {"variant": cfg, "n_features": len(feats)}
    base = linear.fit_ridge(g, 0.0, True, mask)

    def cv(cands):
        res = linear.evaluate_candidates(g, [dict(c, kind="ridge") for c in cands], mask)
        return list(res.groupby("candidate")["rmse"].mean().sort_index())

    if model == "ridge_search":
        best, s, _ = search.search(cv, maps.RIDGE_SPACE, n_iter=int(cfg.get("n_iter", 30)), rounds=2, seed=seed)
        tuned = linear.fit_ridge(g, float(best["alpha"]), bool(best["fit_intercept"]), mask)
        rmse = _train_rmse(ytr, {"baseline": base, "tuned": tuned}, target, kind)
        final = tuned if _choose(rmse) == "tuned" else base
        report.update(best=best, cv_rmse=s, train_rmse=rmse)
    elif model == "ridge_grid":
        cands = search.grid({"alpha": [0.01, 0.1, 0.5, 1.0, 5.0, 10.0], "fit_intercept": [True, False],
                             "tol": [1e-4, 1e-3]})
        scores = cv(cands)
        best = cands[int(np.argmin(scores))]
        tuned = linear.fit_ridge(g, float(best["alpha"]), bool(best["fit_intercept"]), mask)
        rmse = _train_rmse(ytr, {"baseline": base, "tuned": tuned}, target, kind)
        final = tuned if _choose(rmse) == "tuned" else base
        report.update(best=best, train_rmse=rmse)
    elif model == "loo":
        best, _, _ = search.search(cv, maps.RIDGE_SPACE, n_iter=30, rounds=2, seed=seed)
        a, icept = float(best["alpha"]), bool(best["fit_intercept"])
        tuned = linear.fit_ridge(g, a, icept, mask)
        loo = {}
        for name, m, alpha, i in (("baseline", base, 0.0, True), ("tuned", tuned, a, icept)):
            r = linear.loo_residuals(ytr, g, m, "__y", key, alpha=alpha, scale_mask=mask, intercept=i)
            loo[name] = linear.loo_summary(r).first()["loo_mae"]
        final = tuned if _choose(loo) == "tuned" else base
        report.update(best=best, loo_mae=loo)
    elif model == "bayes":
        final = linear.fit_bayes_ridge(g, int(cfg.get("max_iter", 300)), scale_mask=mask)
        report.update(alpha_=final.info["alpha_"], lambda_=final.info["lambda_"])
    elif model in ("lasso_cv", "enet_cv"):
        ratios = [1.0] if model == "lasso_cv" else maps.ELASTIC_NET_L1_RATIOS
        gb = linear.gram(folds.block_folds(rows.drop("__fold"), key, 5, out="__fold"), feats, "__y",
                         fold_col="__fold", indicators=indicators, products=products)
        _, final = linear.elastic_net_path(gb, ratios, maps.LASSO_N_ALPHAS, maps.LASSO_EPS)
        report.update(alpha=final.info["alpha"], l1_ratio=final.info["l1_ratio"])
    else:
        raise ValueError(model)
    report["coef"] = dict(zip(feats, np.round(final.coef, 6)))
    return _linear_out(final, sc, key, target, kind), report


def _run_ml(train, score, cfg, key, target, seed):
    from ..operators import knn
    ytr, sc, feats, _, kind = _prepare(train, score, cfg, key, target)
    ytr = ensure_parallelism(preprocess.assemble(ytr, feats).withColumn("__key", F.col(key))).cache()
    sc = preprocess.assemble(sc, feats)
    model = cfg["model"]
    report = {"variant": cfg, "n_features": len(feats)}
    inv = features.target_inverse
    if model == "knn":
        # components x k x weights x metric by the mean RMSE over shuffled folds of
        # the training rows; the folds' seed is their own, not that of a hold-out
        ytr = ytr.withColumn("__f", hash_bucket(key, int(cfg.get("k", 5)), seed + 1))
        sizes = [n for n in cfg["pca"] if n <= len(feats)]  # more components than features: no such point
        fitted = {n: preprocess.Pca("features", n, output_col="__pc").fit(ytr) for n in sizes}

        def points(job: tuple) -> list:
            n, f = job
            full = fitted[n].transform(ytr)
            got = knn.knn_grid(full.where(F.col("__f") == f), full.where(F.col("__f") != f), key, "__pc", "__y", "__y",
                               ks=maps.KNN_NEIGHBORS)
            return [(n, r["metric"], r["k"], r["weights"], r["rmse"]) for r in got.collect()]

        # the folds' searches are small jobs of their own: several at a time
        with ThreadPool(4) as pool:
            run = inheritable_thread_target(ytr.sparkSession)(points)
            rows = [r for got in pool.map(run, [(n, f) for n in sizes for f in range(int(cfg.get("k", 5)))], chunksize=1) for r in got]
        if any(r[-1] is None for r in rows):
            raise ValueError("a fold without rows: no score to choose by")
        mean: dict = {}
        for n, m, kk, w, rmse in rows:
            mean.setdefault((n, m, kk, w), []).append(rmse)
        chosen = min(mean, key=lambda c: (sum(mean[c]) / len(mean[c]), str(c)))
        best = dict(zip(("n", "metric", "k", "weights"), chosen))
        pca = fitted[best["n"]]
        base, q = pca.transform(ytr), pca.transform(sc)
        report.update(cv_rmse={str(c): sum(v) / len(v) for c, v in mean.items()})
        pred = knn.knn_regress(q, base, key, "__pc", "__y", best["k"], best["weights"], best["metric"])
        report.update(k=best["k"], weights=best["weights"], metric=best["metric"], n_components=pca.k)
        out = pred.select(key, F.greatest(inv("prediction", kind), F.lit(0.0)).alias(target))
        return out, report
    if model not in _TREES:
        raise ValueError(model)
    family = _TREES[model]
    # the forests choose on validation rows and refit on all; the others choose on the training rows
    held = selection.is_validation(key)
    by_valid = model in ("forest_grid", "forest_search")
    part, judge = (ytr.where(~held).cache(), ytr.where(held)) if by_valid else (ytr, ytr)
    folded = part.withColumn("__fold", hash_bucket(key, int(cfg.get("k", 3)), seed)).cache()
    evaluate = family["cv"](folded, family["make"], int(cfg.get("k", 3)), seed)
    if "grid" in family:
        cands = search.grid(family["grid"])
        scores = evaluate(cands)
        best = cands[int(np.argmin(scores))]
        history = list(zip(cands, scores))
    else:
        best, _, rounds = search.search(evaluate, family["space"], int(cfg["n_iter"]), rounds=2, seed=seed)
        history = [(c, s) for _, c, s in rounds]
    make = family["make"]
    fitted = {"baseline": make(family["base"], seed).fit(part), "tuned": make(best, seed).fit(part)}
    scores = {n: _tree_rmse(m.transform(judge), target, kind) for n, m in fitted.items()}
    name = selection.choose(scores)
    final = make({"baseline": family["base"], "tuned": best}[name], seed).fit(ytr) if by_valid else fitted[name]
    report.update(best=best, cv_rmse=history, chosen=name, **{"valid_rmse" if by_valid else "train_rmse": scores})
    out = final.transform(sc).select(key, F.greatest(inv("prediction", kind), F.lit(0.0)).alias(target))
    return out, report


def _tree_rmse(scored: DataFrame, target: str, kind: str):
    """Original-scale RMSE of a transformed frame."""
    p = F.greatest(features.target_inverse("prediction", kind), F.lit(0.0))
    return metrics.regression_metrics(scored.select(target, p.alias("p")), target, "p").first()["rmse"]


def _growth(c: dict) -> forest.Growth:
    return forest.Growth(c["maxDepth"], c["minInstancesPerNode"], max_features=c.get("featureSubsetStrategy"))


def _boost(c: dict, seed: int) -> boosting.Boost:
    return boosting.Boost(c["n_estimators"], c["learning_rate"], c["max_depth"], c.get("num_leaves"), c["subsample"],
                          c["colsample"] or 1.0, c.get("l1", 0.0), c.get("l2", 1.0), min_child=c.get("min_child", 1.0), seed=seed)


class _Fit:
    """A model of a family with given parameters, to be fitted on the rows of
    ``_run_ml`` (``features``, ``__y``, ``__key``)."""

    def __init__(self, fit):
        self.fit = fit


def _forest(c: dict, seed: int) -> _Fit:
    return _Fit(lambda df: forest.fit_forest(df, label="__y", key="__key", n_trees=c["numTrees"], limits=_growth(c), seed=seed))


def _boosted(c: dict, seed: int) -> _Fit:
    return _Fit(lambda df: boosting.fit_boosted(df, _boost(c, seed), label="__y", key="__key"))


def _adaboosted(c: dict, seed: int) -> _Fit:
    return _Fit(lambda df: adaboost.fit_adaboost(df, adaboost.Ada(**c), label="__y", key="__key"))


def _forest_cv(df: DataFrame, make, k: int, seed: int):
    return lambda cands: forest.cross_validate(df, [forest.Candidate(c["numTrees"], _growth(c)) for c in cands], "__fold", k,
                                               label="__y", key="__key", seed=seed)


def _boosted_cv(df: DataFrame, make, k: int, seed: int):
    return lambda cands: boosting.cross_validate(df, [_boost(c, seed) for c in cands], "__fold", k, label="__y", key="__key")


def _adaboosted_cv(df: DataFrame, make, k: int, seed: int):
    return lambda cands: adaboost.cross_validate(df, [adaboost.Ada(**c) for c in cands], "__fold", k, label="__y", key="__key")


_TREES = {
    "forest_grid": {"cv": _forest_cv, "make": _forest, "base": maps.FOREST_BASELINE, "grid": maps.FOREST_GRID},
    "forest_search": {"cv": _forest_cv, "make": _forest, "base": maps.FOREST_BASELINE, "space": maps.FOREST_SAMPLED_SPACE},
    "gbt_search": {"cv": _boosted_cv, "make": _boosted, "base": maps.BOOSTED_BASELINE, "space": maps.BOOSTED_SPACE},
    "adaboost_search": {"cv": _adaboosted_cv, "make": _adaboosted, "base": maps.ADABOOST_BASELINE, "space": maps.ADABOOST_SPACE},
}
