"""Tree ensembles (M7-M10) on MLlib.  Tree statistics are computed by the
executors (binned split search); the driver only grows the tree structure."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..session import cut_lineage, ensure_parallelism

MAX_SPARK_DEPTH = 30


def spark_depth(d) -> int:
    """``None`` (unlimited) and depths above MLlib's limit map to 30."""
    return MAX_SPARK_DEPTH if d is None else int(min(int(d), MAX_SPARK_DEPTH))


def _subset(v) -> str:
    if v is None:
        return "all"
    if isinstance(v, float):
        return "all" if v >= 1.0 else str(v)
    return str(v)


def forest(features_col: str = "features", label: str = "label", n_trees: int = 100,
           max_depth=None, min_leaf: int = 1, min_split: int | None = None,
           max_features=None, seed: int = 42, max_bins: int = 64) -> RandomForestRegressor:
    """M7.  ``max_features=None`` means every feature at every split (the
    reference library's regression default); ``min_split`` has no MLlib
    parameter and maps to ``minInstancesPerNode = max(leaf, ceil(split/2))``."""
    leaf = int(min_leaf)
    if min_split:
        leaf = max(leaf, math.ceil(int(min_split) / 2))
    return RandomForestRegressor(featuresCol=features_col, labelCol=label, numTrees=int(n_trees),
                                 maxDepth=spark_depth(max_depth), minInstancesPerNode=leaf,
                                 featureSubsetStrategy=_subset(max_features), seed=seed,
                                 maxBins=max_bins, subsamplingRate=1.0, bootstrap=True)


def boosted(features_col: str = "features", label: str = "label", n_trees: int = 100,
            learning_rate: float = 0.1, max_depth: int = 6, subsample: float = 1.0,
            min_child: int = 1, gamma: float = 0.0, colsample=None, seed: int = 42,
            max_bins: int = 64, validation_col: str | None = None) -> GBTRegressor:
    """M8/M9 (squared error).  L1/L2 leaf penalties and leaf-count limits have
    no MLlib parameter and are not offered."""
    kw = dict(featuresCol=features_col, labelCol=label, maxIter=int(n_trees), stepSize=float(learning_rate),
              maxDepth=spark_depth(max_depth), subsamplingRate=float(subsample),
              minInstancesPerNode=int(min_child), minInfoGain=float(gamma),
              featureSubsetStrategy=_subset(colsample), seed=seed, maxBins=max_bins, lossType="squared")
    if validation_col:
        kw["validationIndicatorCol"] = validation_col
    return GBTRegressor(**kw)


def validation_curve(model, valid: DataFrame, label: str) -> list:
    """Validation MSE after 1..K trees of a boosted model in one pass.  Each
    tree scores a row once into one array column; an Arrow UDF turns it into
    the K cumulative squared errors (referencing the tree outputs only once
    keeps the optimizer from inlining K^2 model copies)."""
    from pyspark.sql.types import ArrayType

    cur = valid.select(model.getFeaturesCol(), F.col(label).cast("double").alias("__y"))
    names = []
    for i, t in enumerate(model.trees):
        nm = f"__t{i}"
        cur = t.copy().setPredictionCol(nm).transform(cur)
        names.append(nm)
    w = np.asarray(model.treeWeights, dtype=np.float64)

    @F.pandas_udf(ArrayType(DoubleType()))
    def cum_sq_err(preds: pd.Series, y: pd.Series) -> pd.Series:
        P = np.stack(preds.to_numpy())
        err = (y.to_numpy()[:, None] - np.cumsum(P * w, axis=1)) ** 2
        return pd.Series(list(err))

    errs = cur.select(F.posexplode(cum_sq_err(F.array(*names), F.col("__y"))).alias("i", "e"))
    got = {r["i"]: r["m"] for r in errs.groupBy("i").agg(F.avg("e").alias("m")).collect()}  # K rows
    return [float(got[i]) for i in range(len(names))]


def best_iteration(model, valid: DataFrame, label: str) -> int:
    """Patience-style early stop: the tree count with the lowest validation
    loss; keep that many trees (ties -> fewer trees)."""
    return int(np.argmin(validation_curve(model, valid, label))) + 1


# ------------------------------------------------------------ AdaBoost.R2
class AdaBoostR2Model:
    def __init__(self, trees, weights, features_col):
        self.trees, self.weights, self.features_col = trees, weights, features_col

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Weighted median of the tree predictions (an Arrow-batched UDF over
        the per-row prediction array)."""
        cur = df
        names = []
        for i, t in enumerate(self.trees):
            nm = f"__t{i}"
            cur = t.setPredictionCol(nm).transform(cur)
            names.append(nm)
        w = np.asarray(self.weights, dtype=np.float64)

        @F.pandas_udf(DoubleType())
        def wmedian(preds: pd.Series) -> pd.Series:
            P = np.stack(preds.to_numpy())
            order = np.argsort(P, axis=1, kind="stable")
            cdf = np.cumsum(w[order], axis=1)
            hit = cdf >= 0.5 * cdf[:, -1:]
            pick = hit.argmax(axis=1)
            return pd.Series(P[np.arange(len(P)), order[np.arange(len(P)), pick]])

        return cur.withColumn(out, wmedian(F.array(*names))).drop(*names)


def adaboost_r2(df: DataFrame, features_col: str, label: str, n_estimators: int = 50,
                learning_rate: float = 1.0, loss: str = "linear", max_depth: int = 3,
                seed: int = 42, max_bins: int = 64) -> AdaBoostR2Model:
    """M10, AdaBoost.R2 (Drucker 1997) with weights passed to the trees
    (deterministic) instead of weighted resampling.  Each round: one tree fit,
    two aggregates (max error; weighted loss and total weight), one weight
    update.  The weights are checkpointed every round: round k's weights
    depend on all k trees, so an uncut lineage would refit-score k times."""
    cur = ensure_parallelism(df.select(features_col, F.col(label).cast("double").alias(label)))
    cur = cut_lineage(cur.withColumn("__w", F.lit(1.0)))
    trees, weights = [], []
    for it in range(n_estimators):
        dt = DecisionTreeRegressor(featuresCol=features_col, labelCol=label, weightCol="__w",
                                   maxDepth=spark_depth(max_depth), seed=seed + it, maxBins=max_bins,
                                   predictionCol="__p")
        m = dt.fit(cur)
        scored = m.transform(cur).withColumn("__e", F.abs(F.col("__p") - F.col(label)))
        # one aggregate: max error and the weighted sums the linear/square
        # losses need (L-bar = sum(w e^q) / (emax^q sum(w)))
        st = scored.agg(F.max("__e").alias("emax"), F.sum("__w").alias("ws"),
                        F.sum(F.col("__w") * F.col("__e")).alias("we"),
                        F.sum(F.col("__w") * F.col("__e") * F.col("__e")).alias("wee")).first()
        emax = st["emax"] or 0.0
        if emax <= 0:  # perfect learner: keep it and stop
            trees.append(m)
            weights.append(1.0)
            break
        e = F.col("__e") / F.lit(emax)
        L = e if loss == "linear" else (e * e if loss == "square" else 1 - F.exp(-e))
        scored = scored.withColumn("__L", L)
        if loss == "linear":
            lbar = float(st["we"]) / (emax * float(st["ws"]))
        elif loss == "square":
            lbar = float(st["wee"]) / (emax * emax * float(st["ws"]))
        else:
            lbar = float(scored.agg(F.sum(F.col("__w") * F.col("__L"))).first()[0]) / float(st["ws"])
        tot = {"ws": st["ws"]}
        if lbar <= 0 or lbar >= 0.5:
            if lbar <= 0 or not trees:
                trees.append(m)
                weights.append(1.0)
            break
        beta = lbar / (1 - lbar)
        trees.append(m)
        weights.append(learning_rate * math.log(1.0 / beta))
        # w <- w * beta^((1-L) rate), rescaled by the current total (keeps weights
        # bounded; the tree fit and L-bar are scale-free)
        cur = scored.select(features_col, label, (F.col("__w") / F.lit(float(tot["ws"])) * F.pow(
            F.lit(beta), (1 - F.col("__L")) * learning_rate)).alias("__w"))
        if it + 1 < n_estimators:
            cur = cut_lineage(cur)
    for t in trees:
        t.setPredictionCol("prediction")
    return AdaBoostR2Model(trees, weights, features_col)
