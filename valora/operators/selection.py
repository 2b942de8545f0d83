"""Model choice on held-out rows and refit of the winner (V4, V5).

Rows split once by a hash of the key under a seed of its own, so the split is
independent of any outer hold-out.  Candidates are fitted on the training part,
compared on the validation part, and the winner is fitted again on all rows.
For the linear family all of this is one pass for the statistics (the validation
part is one more fold of them) and one pass that scores all candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import DEFAULT_SEED, hash_bucket
from . import linear, metrics

_RESOLUTION = 10_000
VALIDATION_SEED = DEFAULT_SEED + 1


@dataclass
class Choice:
    scores: dict  # model name -> validation RMSE
    name: str
    model: linear.LinearModel  # refitted on all rows


def is_validation(key: str, fraction: float = 0.15, seed: int = VALIDATION_SEED) -> Column:
    """K5: true for about ``fraction`` of the keys."""
    return hash_bucket(key, _RESOLUTION, seed) < F.lit(int(round(fraction * _RESOLUTION)))


def choose(scores: dict, baseline: str = "baseline") -> str:
    """The lowest score; a tie goes to the baseline, then to the earlier one.
    A missing score means that nothing was compared: an error."""
    bad = [n for n, s in scores.items() if s is None or math.isnan(s)]
    if bad or not scores:
        raise ValueError(f"no validation score of {bad or 'any model'}: the validation part is empty")
    return min(scores, key=lambda n: (scores[n], n != baseline))


def select_and_refit(df: DataFrame, feats: Sequence[str], fit_label: str, target: str, key: str, tune, *,
                     fraction: float = 0.15, seed: int = VALIDATION_SEED, folds: int = 5, scale_mask=None,
                     inverse=None) -> Choice:
    """Baseline least squares against tuned candidates, by validation RMSE.

    ``tune(gram of the training part) -> {name: (alpha, fit_intercept)}`` may
    search its folds; ``inverse(column)`` brings a prediction back to the scale
    of ``target`` (identity by default)."""
    inverse = inverse or (lambda c: c)
    val = is_validation(key, fraction, seed)
    fold = F.when(val, F.lit(folds)).otherwise(hash_bucket(key, folds, seed + 1))
    both = linear.gram(df.withColumn("__fold", fold), feats, fit_label, fold_col="__fold")
    if folds not in both.folds or len(both.folds) == 1:
        raise ValueError("the training or the validation part is empty")
    part = linear.Gram(both.features, both.shift_x, both.shift_y, {f: s for f, s in both.folds.items() if f != folds})
    tried = {"baseline": (0.0, True), **tune(part)}
    fitted = {n: linear.fit_ridge(part, a, i, scale_mask) for n, (a, i) in tried.items()}
    rows = df.where(val).select(target, F.explode(F.array(*[
        F.struct(F.lit(n).alias("model"), inverse(m.predict_col()).alias("p")) for n, m in fitted.items()])).alias("m"))
    got = metrics.regression_metrics(rows.select(target, "m.*"), target, "p", by=["model"]).collect()
    scores = {n: next((r["rmse"] for r in got if r["model"] == n), None) for n in tried}
    name = choose(scores)
    return Choice(scores, name, linear.fit_ridge(both, *tried[name], scale_mask))
