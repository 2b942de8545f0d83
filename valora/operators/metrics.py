"""Metrics and model choice (V1-V6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """V1/V2: ``n, rmse, mae, r2`` per group in one aggregate.
    r2 = 1 - SSres / (n * var_pop(y)); a constant target gives null r2."""
    err = F.col(y).cast("double") - F.col(p).cast("double")
    out = (df.groupBy(*by) if by else df.groupBy()).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("__sse"),
        F.var_pop(F.col(y).cast("double")).alias("__vy"))
    return (out.withColumn("r2", F.lit(1.0) - F.try_divide(F.col("__sse"), F.col("n") * F.col("__vy")))
            .drop("__sse", "__vy"))


def cv_score(fold_metrics: DataFrame, by: Sequence[str] = ("candidate",),
             metric: str = "rmse") -> DataFrame:
    """V3: mean of the per-fold metric per candidate (the search score is its
    negative)."""
    return (fold_metrics.groupBy(*by)
            .agg(F.avg(metric).alias(f"mean_{metric}"), F.stddev_pop(metric).alias(f"std_{metric}"),
                 F.count(F.lit(1)).alias("n_folds")))


def select_model(metrics: DataFrame, metric: str = "rmse", baseline_col: str = "is_tuned",
                 name_col: str = "model") -> DataFrame:
    """V4: the row with the lowest metric; a tie goes to the baseline
    (``is_tuned = 0``), i.e. the tuned model must be strictly better.
    ``metrics`` has one row per model: a top-1 over it is the feature."""
    w = Window.orderBy(F.col(metric).asc(), F.col(baseline_col).asc(), F.col(name_col).asc())
    return metrics.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
