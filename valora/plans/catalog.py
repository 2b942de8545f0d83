"""Registered queries: each operator of the inventory applied to the driver's
tables (whole tables; roles per FIXTURES.md section 4).  Every callable takes
``(spark, sf_dir)`` and returns a DataFrame whose computed columns carry the
same aliases as the SQL in ``oracle.py``."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import hash_bucket, ordinal_expr
from ..operators import clean, explore, features, folds, linear, maps, metrics, preprocess
from ..session import ensure_checkpoint_dir
from ..sources import io

# ---- fixed values: role maps for the driver tables (not from the reference) ----
PRIORITY_SCORE = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1, "None": 0}
TYPE_SCORE = {"ECONOMY": 1, "STANDARD": 2, "SMALL": 2, "MEDIUM": 3, "LARGE": 4, "PROMO": 5, "None": 0}
FLAG_SCORE = {"A": 3, "N": 2, "R": 1, "F": 2, "O": 1, "None": 0}
RIDGE_ALPHAS = [0.0, 1.0, 10.0, 100.0, 1000.0, 10000.0]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _r(c, n=6):
    return (F.round(c, n) + F.lit(0.0))


def _li_key():
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


def _docs(spark, d):
    return (_t(spark, d, "documents").select("doc_id", "n_chars")
            .join(_t(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left"))


# ------------------------------------------------------------------ S, P
def q_quantile_trim(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.quantile_trim(li, "l_extendedprice", 0.001, 0.999)


def q_exclude_rule(spark, d):
    j = clean.cap(_docs(spark, d), "n_chars", 20000)
    j = clean.exclude(j, (F.col("quality") == 0) & (F.col("n_chars") > 3000))
    return j.select("doc_id", "n_chars", "quality")


def _li_rules(li):
    lo, hi = clean.quantile_bounds(li, "l_extendedprice", 0.001, 0.999)
    return {"trim_low": F.col("l_extendedprice") < lo, "trim_high": F.col("l_extendedprice") > hi,
            "cap": ~(F.col("l_quantity") < 49),
            "rule": (F.col("l_discount") < 0.02) & (F.col("l_quantity") > 45)}


def q_outlier_report(spark, d):
    li = _t(spark, d, "lineitem")
    return clean.outlier_report(li, _li_rules(li))


def q_prune_columns(spark, d):
    c = clean.drop_columns(_t(spark, d, "customer"), ["c_name", "c_nationkey", "c_comment"])
    num, cat = clean.columns_by_role(c)
    return c.select(*num, *cat)


def q_drop_missing(spark, d):
    return clean.drop_missing(_docs(spark, d), ["quality"]).select("doc_id", "quality")


def q_clip_lower(spark, d):
    ev = _t(spark, d, "events").select("event_id", (F.col("value") - 50.0).alias("clipped"))
    return clean.clip_predictions(ev, "clipped").select("event_id", _r(F.col("clipped")).alias("clipped"))


def q_shape_report(spark, d):
    li = _t(spark, d, "lineitem")
    after = clean.quantile_trim(li, "l_extendedprice").drop("l_shipdate")
    return io.shape_report(li, after)


def q_preview(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return io.preview(li, 5, ["l_orderkey", "l_linenumber", "l_extendedprice"])


def q_normalize_nulls(spark, d):
    conv = _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    out = io.normalize_nulls(conv)
    return out.select("conv_id", "turn", "role",
                      F.when(F.col("text").isNull(), 1).otherwise(0).alias("text_is_null"))


# ------------------------------------------------------------------ E
def q_zero_fill(spark, d):
    return features.zero_fill(_docs(spark, d), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


def q_constant_impute(spark, d):
    j = _docs(spark, d).withColumn("quality_cat", F.col("quality").cast("string"))
    m = preprocess.Impute(constant={"quality_cat": "None"}).fit(j)
    return m.transform(j).select("doc_id", "quality_cat")


def q_median_impute(spark, d):
    j = _docs(spark, d)
    m = preprocess.Impute(median=["quality", "toxic"]).fit(j)
    return m.transform(j).select("doc_id", "quality", "toxic")


def q_targeted_impute(spark, d):
    j = _docs(spark, d)
    m = preprocess.Impute(median=["quality"], zero=["toxic"]).fit(j)
    return m.transform(j).select("doc_id", "quality", "toxic")


def q_ordinal_encode(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    o = features.ordinal_encode(o, {"o_orderpriority": PRIORITY_SCORE}, suffix="_score")
    return o.select("o_orderkey", F.col("o_orderpriority_score").alias("priority_score"))


def _part_line(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                          "l_tax", "l_returnflag")
    p = _t(spark, d, "part").select("p_partkey", "p_type")
    return li.join(p, li.l_partkey == p.p_partkey)


def q_weighted_score(spark, d):
    j = _part_line(spark, d).withColumns({
        "t1": ordinal_expr("p_type", TYPE_SCORE), "t2": ordinal_expr("l_returnflag", FLAG_SCORE),
        "sf1": F.col("l_quantity"), "sf2": F.col("l_tax") * 100.0})
    j = features.weighted_sum(j, [("t1", "sf1"), ("t2", "sf2")], "weighted_score")
    j = features.sum_columns(j, ["sf1", "sf2"], "finished_sf")
    j = features.safe_ratio(j, "weighted_score", "finished_sf", "avg_quality")
    return j.select("l_orderkey", "l_linenumber", _r(F.col("weighted_score")).alias("weighted_score"),
                    _r(F.col("finished_sf")).alias("finished_sf"), _r(F.col("avg_quality")).alias("avg_quality"))


def q_guarded_ratio(spark, d):
    li = _t(spark, d, "lineitem")
    li = features.safe_ratio(li, "l_tax", "l_discount", "tax_per_discount")
    return li.select("l_orderkey", "l_linenumber", _r(F.col("tax_per_discount")).alias("tax_per_discount"))


def q_quality_area(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_type", "p_size")
    return p.select("p_partkey", (ordinal_expr("p_type", TYPE_SCORE) * F.col("p_size")).alias("quality_area"))


def q_sum_parts(spark, d):
    li = features.sum_columns(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "total_parts")
    return li.select("l_orderkey", "l_linenumber", _r(F.col("total_parts")).alias("total_parts"))


def q_age_features(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag")
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey).select(
        "l_orderkey", "l_linenumber",
        F.year("l_shipdate").alias("YearSold"), F.year("o_orderdate").alias("ConstructionYear"),
        F.when(F.col("l_returnflag") == "R", F.lit(0))
         .when(F.col("l_returnflag") == "A", F.year("l_shipdate") - 1).alias("RenovationYear"))
    j = features.age_features(j)
    return j.select("l_orderkey", "l_linenumber", F.col("HouseAge").cast("int").alias("house_age"),
                    F.col("RenovationYear").cast("int").alias("renovation_year"),
                    F.col("YearsSinceModification").cast("int").alias("years_since_mod"))


def q_interaction(spark, d):
    li = features.interaction(_t(spark, d, "lineitem"), "l_quantity", "l_discount", "qty_x_disc")
    return li.select("l_orderkey", "l_linenumber", _r(F.col("qty_x_disc")).alias("qty_x_disc"))


def q_weighted_count(spark, d):
    li = features.weighted_count(_t(spark, d, "lineitem"), {"l_quantity": 1.0, "l_linenumber": 0.5},
                                 "weighted_count")
    return li.select("l_orderkey", "l_linenumber", _r(F.col("weighted_count")).alias("weighted_count"))


def q_log_features(spark, d):
    ev = features.log_features(_t(spark, d, "events").select("event_id", "value"), ["value"], keep=True)
    return ev.select("event_id", _r(F.col("value_Log")).alias("value_log"))


def q_target_roundtrip(spark, d):
    ev = _t(spark, d, "events").select("event_id", "value")
    ev = ev.withColumn("y", features.target_forward("value")).withColumn("back", features.target_inverse("y"))
    return ev.select("event_id", _r(F.col("y")).alias("y"), _r(F.col("back")).alias("back"))


def q_quality_index(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    li = features.quality_index(li, ["l_returnflag", "l_linestatus"], FLAG_SCORE, "flag_score")
    return li.select("l_orderkey", "l_linenumber", "flag_score")


# ------------------------------------------------------------------ T
def q_standardize(spark, d):
    li = _t(spark, d, "lineitem")
    cols = ["l_quantity", "l_discount", "l_tax"]
    m = preprocess.Standardize(cols).fit(li)
    out = m.transform(li)
    return out.select("l_orderkey", "l_linenumber", *[_r(F.col(c)).alias(f"z_{c}") for c in cols])


def q_one_hot(spark, d):
    c = folds.split(_t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.5)
    m = preprocess.OneHot(["c_mktsegment"]).fit(c.where("is_test = 0"))
    return m.transform(c).drop("is_test")


def q_ordinal_codes(spark, d):
    p = folds.split(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey", 0.5)
    m = preprocess.OrdinalCodes(["p_brand"], suffix="_code").fit(p.where("is_test = 0"))
    return m.transform(p).select("p_partkey", "p_brand", F.col("p_brand_code").alias("brand_code"))


def q_polynomial(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    pm = preprocess.Polynomial(["l_quantity", "l_discount"], degree=2)
    out = pm.transform(li)
    return out.select("l_orderkey", "l_linenumber", *[_r(F.col(c)).alias(c) for c in pm.output_columns()])


# ------------------------------------------------------------------ K
def q_split(spark, d):
    return folds.split(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.15)


def q_kfold(spark, d):
    return folds.assign_folds(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


def q_block_fold(spark, d):
    return folds.block_folds(_t(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5)


# ------------------------------------------------------------------ V, M
def _li_xy(spark, d, feats=("l_quantity",)):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *feats, "l_extendedprice")
    return li.withColumn("fold", hash_bucket(_li_key(), 5))


def q_rmse_r2(spark, d):
    li = _li_xy(spark, d)
    g = linear.gram(li, ["l_quantity"], "l_extendedprice")
    m = linear.fit_ridge(g, 0.0)
    met = metrics.regression_metrics(m.transform(li), "l_extendedprice", "prediction")
    return met.select("n", _r(F.col("rmse"), 4).alias("rmse"), _r(F.col("mae"), 4).alias("mae"),
                      _r(F.col("r2")).alias("r2"))


def _cv_rows(spark, d):
    li = _li_xy(spark, d)
    g = linear.gram(li, ["l_quantity"], "l_extendedprice", fold_col="fold")
    rows = []
    for a in RIDGE_ALPHAS:
        for f in g.fold_ids():
            tr, va = g.train(f), g.folds[f]
            m = linear.fit_ridge(g, a, stats=tr)
            rows.append((float(a), int(f), float(m.coef[0]), float(m.intercept),
                         float(np.sqrt(linear.sse(g, va, m) / va.n))))
    return rows


def q_ridge_path(spark, d):
    rows = _cv_rows(spark, d)  # alphas x folds from one pass over lineitem
    df = spark.createDataFrame(rows, "alpha double, fold int, coef double, intercept double, val_rmse double")
    return df.select("alpha", "fold", _r(F.col("coef")).alias("coef"), _r(F.col("intercept"), 4).alias("intercept"),
                     _r(F.col("val_rmse"), 4).alias("val_rmse"))


def q_cv_score(spark, d):
    rows = _cv_rows(spark, d)
    df = spark.createDataFrame(rows, "alpha double, fold int, coef double, intercept double, rmse double")
    cv = metrics.cv_score(df, by=["alpha"])
    return cv.select("alpha", _r(F.col("mean_rmse"), 4).alias("mean_rmse"))


def q_select_model(spark, d):
    li = _li_xy(spark, d)
    g = linear.gram(li, ["l_quantity"], "l_extendedprice")
    cands = [("ols", 0, 0.0), ("ridge", 1, 1000.0)]
    rows = []
    for name, tuned, a in cands:
        m = linear.fit_ridge(g, a)
        rows.append((name, tuned, float(np.sqrt(linear.sse(g, g.total, m) / g.total.n))))
    met = spark.createDataFrame(rows, "model string, is_tuned int, rmse double")
    best = metrics.select_model(met)
    return best.select("model", "is_tuned", _r(F.col("rmse"), 4).alias("rmse"))


def q_ols(spark, d):
    li = _li_xy(spark, d, ("l_quantity", "l_discount"))
    g = linear.gram(li, ["l_quantity", "l_discount"], "l_extendedprice")
    m = linear.fit_ridge(g, 0.0)
    return m.coefficients(spark).select("term", _r(F.col("coef"), 4).alias("coef"))


def _part_xy(spark, d):
    return _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")


def q_loo(spark, d):
    p = _part_xy(spark, d)
    g = linear.gram(p, ["p_size"], "p_retailprice")
    m = linear.fit_ridge(g, 10.0)
    r = linear.loo_residuals(p, g, m, "p_retailprice", "p_partkey", alpha=10.0)
    return r.select("p_partkey", _r(F.col("loo_residual")).alias("loo_residual"))


def q_loo_no_intercept(spark, d):
    p = _part_xy(spark, d)
    g = linear.gram(p, ["p_size"], "p_retailprice")
    m = linear.fit_ridge(g, 10.0, intercept=False)
    r = linear.loo_residuals(p, g, m, "p_retailprice", "p_partkey", alpha=10.0, intercept=False)
    return r.select("p_partkey", _r(F.col("loo_residual")).alias("loo_residual"))


def q_select_refit(spark, d):
    from ..operators import selection
    p = _part_xy(spark, d)
    c = selection.select_and_refit(p, ["p_size"], "p_retailprice", "p_retailprice", "p_partkey",
                                   lambda g: {"ridge_100": (100.0, True), "ridge_100000": (100000.0, True)})
    rows = [(n, float(s), n == c.name, float(c.model.coef[0]) if n == c.name else None,
             float(c.model.intercept) if n == c.name else None) for n, s in c.scores.items()]
    out = spark.createDataFrame(rows, "model string, val_rmse double, chosen boolean, coef double, icept double")
    return out.select("model", _r(F.col("val_rmse"), 4).alias("val_rmse"), "chosen",
                      _r(F.col("coef")).alias("refit_coef"), _r(F.col("icept"), 4).alias("refit_intercept"))


def q_scaled_polynomial(spark, d):
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    pipe = preprocess.build_pipeline(["l_quantity", "l_discount"], poly_degree=2).fit(li)
    return pipe.transform(li).select("l_orderkey", "l_linenumber",
                                     *[_r(F.col(c)).alias(c) for c in preprocess.feature_columns(pipe)])


def q_impute_nan(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") == 7, float("nan")).otherwise(
        F.col("p_retailprice") / F.col("p_size")).alias("v"))
    return preprocess.Impute(median=["v"]).fit(p).transform(p).select("p_partkey", _r(F.col("v")).alias("v"))


def q_csv_types(spark, d):
    """Text cells with null tokens, written as CSV and read back with types."""
    from ..session import owned_path
    path = f"{owned_path(spark, 'csv-types')}/cells.csv"
    size, token = F.col("p_size"), F.element_at(F.array(F.lit("None"), F.lit("null"), F.lit("NaN"), F.lit("NA")),
                                                F.pmod(F.col("p_size"), F.lit(4)) + 1)
    p = _t(spark, d, "part").select(
        F.col("p_partkey").alias("k"), F.when(size % 5 == 0, token).otherwise(size.cast("string")).alias("n"),
        F.when(size % 7 == 0, token).otherwise((size / 4).cast("string")).alias("x"),
        F.when(size % 3 == 0, F.lit(" NA ")).otherwise(F.col("p_type")).alias("s"))
    p.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return io.read_table(spark, [path])


def q_loo_summary(spark, d):
    p = _part_xy(spark, d)
    g = linear.gram(p, ["p_size"], "p_retailprice")
    m = linear.fit_ridge(g, 10.0)
    s = linear.loo_summary(linear.loo_residuals(p, g, m, "p_retailprice", "p_partkey", alpha=10.0))
    return s.select("n", _r(F.col("loo_mae")).alias("loo_mae"), _r(F.col("loo_rmse")).alias("loo_rmse"))


def _enet_path(spark, d, ratio):
    p = _part_xy(spark, d)
    g = linear.gram(p, ["p_size"], "p_retailprice")
    alphas = linear.alpha_grid(g, ratio, 100, 1e-3, scale_mask=[True])
    rows = []
    for i, a in enumerate(alphas):
        m = linear.fit_elastic_net(g, float(a), ratio, scale_mask=[True])
        rows.append((i, float(a), float(m.coef[0]), float(m.intercept)))
    df = spark.createDataFrame(rows, "alpha_idx int, alpha double, coef double, intercept double")
    return df.select("alpha_idx", _r(F.col("alpha")).alias("alpha"), _r(F.col("coef")).alias("coef"),
                     _r(F.col("intercept")).alias("intercept"))


def q_lasso_1d(spark, d):
    return _enet_path(spark, d, 1.0)


def q_elastic_net_1d(spark, d):
    return _enet_path(spark, d, 0.5)


def q_bayes_ridge(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    g = linear.gram(p, ["p_size"], "p_retailprice")
    m = linear.fit_bayes_ridge(g, max_iter=300, scale_mask=[True])
    return m.transform(p).select("p_partkey", _r(F.col("prediction")).alias("prediction"))


# ------------------------------------------------------------------ A
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_corr_matrix(spark, d):
    m = explore.corr_matrix(_t(spark, d, "lineitem"), LI_NUM)
    return m.select("a", "b", _r(F.col("r")).alias("r"))


def q_corr_rank(spark, d):
    r = explore.corr_rank(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
                          "l_extendedprice")
    return r.select("feature", _r(F.col("r")).alias("r"), "rank")


def q_corr_topk(spark, d):
    r = explore.corr_topk(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber"],
                          "l_extendedprice", k=2)
    return r.select("feature", _r(F.col("r")).alias("r"), "rank")


def q_corr_pairs(spark, d):
    p = explore.corr_pairs(_t(spark, d, "part"), ["p_partkey", "p_size", "p_retailprice"], 0.4)
    return p.select("a", "b", _r(F.col("r")).alias("r"))


def q_cardinality_gate(spark, d):
    return explore.cardinality(_t(spark, d, "part"), ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])


def q_group_median(spark, d):
    g = explore.group_median(_t(spark, d, "part"), "p_type", "p_retailprice")
    return g.select("p_type", _r(F.col("median")).alias("median"))


def q_box_stats(spark, d):
    b = explore.box_stats(_t(spark, d, "part"), "p_brand", "p_retailprice")
    return b.select("p_brand", *[_r(F.col(c)).alias(c) for c in
                                 ["q1", "median", "q3", "iqr", "whisker_lo", "whisker_hi"]], "n", "n_fliers")


def q_scatter_bins(spark, d):
    return explore.scatter_bins(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 10)


def _score_models(spark, d):
    p = folds.split(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 0.5)
    p = p.withColumn("y", features.target_forward("p_retailprice"))
    g = linear.gram(p.where("is_test = 0"), ["p_size"], "y")
    return p, g


def q_score_table(spark, d):
    p, g = _score_models(spark, d)
    m = linear.fit_ridge(g, 0.0)
    s = m.transform(p, "log_pred").withColumn("prediction", features.target_inverse("log_pred"))
    s = clean.clip_predictions(s, "prediction")
    return s.select("p_partkey", _r(F.col("prediction"), 4).alias("prediction"))


def q_compare_runs(spark, d):
    p, g = _score_models(spark, d)
    a = linear.fit_ridge(g, 0.0).transform(p).select("p_partkey", "prediction")
    b = linear.fit_ridge(g, 1000.0).transform(p).select("p_partkey", "prediction")
    c = explore.compare_runs(a, b, "p_partkey")
    return c.select("n_matched", "n_unmatched", *[_r(F.col(x)).alias(x) for x in [
        "mean_abs_diff", "max_abs_diff", "min_a", "mean_a", "max_a", "min_b", "mean_b", "max_b"]])


QUERIES = {
    "quantile_trim": q_quantile_trim,
    "exclude_rule": q_exclude_rule,
    "outlier_report": q_outlier_report,
    "prune_columns": q_prune_columns,
    "drop_missing": q_drop_missing,
    "clip_lower": q_clip_lower,
    "shape_report": q_shape_report,
    "preview": q_preview,
    "normalize_nulls": q_normalize_nulls,
    "zero_fill": q_zero_fill,
    "constant_impute": q_constant_impute,
    "median_impute": q_median_impute,
    "targeted_impute": q_targeted_impute,
    "ordinal_encode": q_ordinal_encode,
    "weighted_score": q_weighted_score,
    "guarded_ratio": q_guarded_ratio,
    "quality_area": q_quality_area,
    "sum_parts": q_sum_parts,
    "age_features": q_age_features,
    "interaction": q_interaction,
    "weighted_count": q_weighted_count,
    "log_features": q_log_features,
    "target_roundtrip": q_target_roundtrip,
    "quality_index": q_quality_index,
    "standardize": q_standardize,
    "one_hot": q_one_hot,
    "ordinal_codes": q_ordinal_codes,
    "polynomial": q_polynomial,
    "split": q_split,
    "kfold": q_kfold,
    "block_fold": q_block_fold,
    "rmse_r2": q_rmse_r2,
    "cv_score": q_cv_score,
    "select_model": q_select_model,
    "ols": q_ols,
    "ridge_path": q_ridge_path,
    "loo": q_loo,
    "loo_summary": q_loo_summary,
    "loo_no_intercept": q_loo_no_intercept,
    "select_refit": q_select_refit,
    "scaled_polynomial": q_scaled_polynomial,
    "impute_nan": q_impute_nan,
    "csv_types": q_csv_types,
    "lasso_1d": q_lasso_1d,
    "elastic_net_1d": q_elastic_net_1d,
    "bayes_ridge": q_bayes_ridge,
    "corr_matrix": q_corr_matrix,
    "corr_rank": q_corr_rank,
    "corr_topk": q_corr_topk,
    "corr_pairs": q_corr_pairs,
    "cardinality_gate": q_cardinality_gate,
    "group_median": q_group_median,
    "box_stats": q_box_stats,
    "scatter_bins": q_scatter_bins,
    "score_table": q_score_table,
    "compare_runs": q_compare_runs,
}


# ------------------------------------------------------------------ M11
def _emb_split(spark, d):
    e = folds.split(_t(spark, d, "embeddings").select("vec_id", "embedding", "label"), "vec_id", 0.5)
    return e.where("is_test = 1"), e.where("is_test = 0")


def _knn(spark, d, weights, metric):
    from ..operators import knn
    q, b = _emb_split(spark, d)
    p = knn.knn_regress(q, b, "vec_id", "embedding", "label", k=5, weights=weights, metric=metric)
    return p.select("vec_id", _r(F.col("prediction")).alias("prediction"))


def q_knn_uniform(spark, d):
    return _knn(spark, d, "uniform", "euclidean")


def q_knn_distance(spark, d):
    return _knn(spark, d, "distance", "euclidean")


def q_knn_manhattan(spark, d):
    return _knn(spark, d, "uniform", "manhattan")


QUERIES.update({"knn_uniform": q_knn_uniform, "knn_distance": q_knn_distance,
                "knn_manhattan": q_knn_manhattan})


# ------------------------------------------------------------------ more A / P / T
def q_fliers(spark, d):
    ev = _t(spark, d, "events").select("event_id", "event_type", "value")
    return explore.fliers(ev, "event_type", "value", "event_id")


def q_prune_correlated(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out, _ = explore.prune_correlated(p, ["p_partkey", "p_size", "p_retailprice"], 0.4)
    return out


def q_feature_names(spark, d):
    c = _t(spark, d, "customer").select("c_acctbal", "c_mktsegment")
    pipe = preprocess.build_pipeline(["c_acctbal"], ["c_mktsegment"]).fit(c)
    names = preprocess.feature_names(pipe)
    return spark.createDataFrame(list(enumerate(names)), "idx int, name string")


# ------------------------------------------------------------------ rows-only: iterative / MLlib
def q_pca_share(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    m = preprocess.Pca("embedding", 0.95).fit(e)
    ex = m.explained(spark)
    return ex.withColumn("chosen_k", F.lit(m.k)).select(
        "component", _r(F.col("share")).alias("share"), _r(F.col("cumulative")).alias("cumulative"), "chosen_k")


def q_pca_project(spark, d):
    e = _t(spark, d, "embeddings").select("vec_id", "embedding")
    m = preprocess.Pca("embedding", 8).fit(e)
    out = m.transform(e)
    return out.select("vec_id", *[_r(F.col("pca")[i]).alias(f"pc{i}") for i in range(8)])


def q_knn_grid(spark, d):
    from ..operators import knn
    q, b = _emb_split(spark, d)
    g = knn.knn_grid(q, b, "vec_id", "embedding", "label", "label")
    return g.select("metric", "k", "weights", _r(F.col("rmse")).alias("rmse"))


def _ml_frame(spark, d):
    from .workflow import staged_property_split
    t = staged_property_split(spark, d)
    t = features.age_features(t).withColumn("y", features.target_forward("HotelValue"))
    num = ["UsableArea", "Discount", "Tax", "LandArea", "HouseAge", "YearsSinceModification"]
    codes = preprocess.OrdinalCodes(["PropertyType", "ReturnFlag", "Priority"], suffix="_code").fit(
        t.where("is_test = 0"))
    t = codes.transform(t)
    cols = num + ["PropertyType_code", "ReturnFlag_code", "Priority_code"]
    imp = preprocess.Impute(median=cols).fit(t.where("is_test = 0"))
    return preprocess.assemble(imp.transform(t), cols)


def _fit_input(t):
    """Training rows for MLlib: spread over the cores and cached (the tree
    learners traverse them once per level)."""
    from ..session import ensure_parallelism
    return ensure_parallelism(t.where("is_test = 0")).cache()


def _tree_out(model, t):
    s = model.transform(t.where("is_test = 1"))
    return s.select("Id", _r(features.target_inverse(F.col("prediction")), 4).alias("prediction"))


def q_random_forest(spark, d):
    from ..operators import forest
    t = _ml_frame(spark, d)
    return _tree_out(forest.fit_forest(t.where("is_test = 0"), label="y", key="Id", n_trees=100), t)


def q_gbt(spark, d):
    from ..operators import boosting
    t = _ml_frame(spark, d)
    return _tree_out(boosting.fit_boosted(t.where("is_test = 0"), boosting.Boost(100, 0.3, 6), label="y", key="Id"), t)


def q_leafwise_boost(spark, d):
    """M9: trees that grow leaf by leaf."""
    from ..operators import boosting
    from ..operators.maps import LEAFWISE_BASELINE as c
    t = _ml_frame(spark, d)
    b = boosting.Boost(c["n_estimators"], c["learning_rate"], None, c["num_leaves"], l2=c["l2"], min_child=c["min_child"])
    return _tree_out(boosting.fit_boosted(t.where("is_test = 0"), b, label="y", key="Id"), t)


def q_adaboost_r2(spark, d):
    from ..operators import adaboost
    t = _ml_frame(spark, d)
    return _tree_out(adaboost.fit_adaboost(t.where("is_test = 0"), adaboost.Ada(50), label="y", key="Id"), t)


def q_forest_grid(spark, d):
    """H1 on trees: the whole grid over a fold column (k=3); a null depth is no limit."""
    from ..operators import forest, search
    from ..operators.maps import FOREST_GRID
    t = folds.assign_folds(_ml_frame(spark, d).where("is_test = 0"), "Id", 3)
    points = search.grid(FOREST_GRID)
    cands = [forest.Candidate(c["numTrees"], forest.Growth(c["maxDepth"], c["minInstancesPerNode"])) for c in points]
    scores = forest.cross_validate(t, cands, "fold", 3, label="y", key="Id")
    rows = [(c["numTrees"], c["maxDepth"], c["minInstancesPerNode"], s) for c, s in zip(points, scores)]
    return spark.createDataFrame(rows, "num_trees int, max_depth int, min_leaf int, cv_rmse double")


def _stump_frame(spark, d):
    """Three numbers of few distinct values each."""
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return preprocess.assemble(li.withColumn("y", F.col("l_extendedprice").cast("double") / 1000.0), ["l_quantity", "l_discount", "l_tax"])


def _counted(model, t):
    return (model.transform(t).groupBy(_r(F.col("prediction"), 6).alias("prediction"))
            .agg(F.count("*").alias("n"), _r(F.avg("y"), 6).alias("mean_y")))


def q_tree_stump(spark, d):
    """M7: one tree of depth one, without resampling."""
    from ..operators import forest
    t = _stump_frame(spark, d)
    return _counted(forest.fit_forest(t, label="y", n_trees=1, limits=forest.Growth(1, resample=False)), t)


def q_boost_stump(spark, d):
    """M8: one boosted tree of depth one with both penalties and a least gain."""
    from ..operators import boosting
    t = _stump_frame(spark, d)
    b = boosting.Boost(1, 0.3, 1, l1=1000.0, l2=500.0, gamma=10.0, min_child=50)
    return _counted(boosting.fit_boosted(t, b, label="y", bins=256), t)


def q_ridge_search(spark, d):
    """H2 on the linear family: sampled candidates, all folds from one pass."""
    from ..operators import search
    from ..operators.maps import RIDGE_SPACE
    li = _li_xy(spark, d, ("l_quantity", "l_discount", "l_tax"))
    li = li.withColumn("y", F.log1p("l_extendedprice"))
    g = linear.gram(li, ["l_quantity", "l_discount", "l_tax"], "y", fold_col="fold")
    mask = [True, True, True]

    def ev(cands):
        res = linear.evaluate_candidates(g, [dict(c, kind="ridge") for c in cands], mask)
        return list(res.groupby("candidate")["rmse"].mean().sort_index())

    best, score, hist = search.search(ev, RIDGE_SPACE, n_iter=30, rounds=2)
    rows = [(r, float(c["alpha"]), int(bool(c["fit_intercept"])), float(s)) for r, c, s in hist]
    return spark.createDataFrame(rows, "round int, alpha double, fit_intercept int, cv_rmse double")


def q_lasso_cv(spark, d):
    """M4 as LassoCV: contiguous 5 blocks (K3), 100-alpha path, best by mean MSE."""
    p = folds.block_folds(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 5)
    g = linear.gram(p, ["p_size"], "p_retailprice", fold_col="fold")
    path, best = linear.elastic_net_path(g, [1.0], scale_mask=[True])
    mean = path.groupby(["alpha_idx", "alpha"], as_index=False)["mse"].mean()
    mean["chosen"] = (mean["alpha"] == best.info["alpha"]).astype(int)
    df = spark.createDataFrame(mean[["alpha_idx", "alpha", "mse", "chosen"]].astype(
        {"alpha_idx": "int32", "chosen": "int32"}))
    return df.select("alpha_idx", _r(F.col("alpha")).alias("alpha"), _r(F.col("mse")).alias("mse"), "chosen")


def q_elastic_net_cv(spark, d):
    from ..operators.maps import LASSO_EPS, LASSO_N_ALPHAS
    p = folds.block_folds(_t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 5)
    g = linear.gram(p, ["p_size"], "p_retailprice", fold_col="fold")
    path, best = linear.elastic_net_path(g, [0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0], n_alphas=LASSO_N_ALPHAS,
                                         eps=LASSO_EPS, scale_mask=[True])
    df = spark.createDataFrame(path.astype({"alpha_idx": "int32", "fold": "int32"}))
    return df.select("l1_ratio", "alpha_idx", _r(F.col("alpha")).alias("alpha"), "fold",
                     _r(F.col("mse")).alias("mse"))


def q_train_tune_score(spark, d):
    from .workflow import staged_property_split, train_tune_score
    t = staged_property_split(spark, d)
    out, _ = train_tune_score(t.where("is_test = 0").drop("is_test"),
                              t.where("is_test = 1").drop("is_test", "HotelValue"))
    return out


def q_score_stream(spark, d):
    from ..streaming.scoring import score_stream
    p, g = _score_models(spark, d)
    m = linear.fit_ridge(g, 0.0)
    stream = (spark.readStream.schema(_t(spark, d, "part").schema).option("maxFilesPerTrigger", 1)
              .parquet(f"{d}/part[.]parquet"))
    out = score_stream(stream, lambda df: clean.clip_predictions(
        m.transform(df, "log_pred").withColumn("prediction", features.target_inverse("log_pred")),
        "prediction").select("p_partkey", _r(F.col("prediction"), 4).alias("prediction")))
    return out


QUERIES.update({
    "fliers": q_fliers, "prune_correlated": q_prune_correlated, "feature_names": q_feature_names,
    "pca_share": q_pca_share, "pca_project": q_pca_project, "knn_grid": q_knn_grid,
    "random_forest": q_random_forest, "gbt": q_gbt, "adaboost_r2": q_adaboost_r2, "leafwise_boost": q_leafwise_boost,
    "tree_stump": q_tree_stump, "boost_stump": q_boost_stump,
    "forest_grid": q_forest_grid, "ridge_search": q_ridge_search, "lasso_cv": q_lasso_cv,
    "elastic_net_cv": q_elastic_net_cv, "train_tune_score": q_train_tune_score,
    "score_stream": q_score_stream,
})


# ------------------------------------------------------------------ 2.11 pipeline variants
def _variant_query(name):
    def q(spark, d):
        from .variants import run_variant
        from .workflow import staged_property_split
        t = staged_property_split(spark, d)
        out, _ = run_variant(t.where("is_test = 0").drop("is_test"),
                             t.where("is_test = 1").drop("is_test", "HotelValue"), name)
        return out
    q.__name__ = f"q_variant_{name}"
    return q


def _register_variants():
    from .variants import VARIANTS
    QUERIES.update({f"variant_{n.lower()}": _variant_query(n) for n in VARIANTS})


_register_variants()


# ------------------------------------------------------------------ S1, S3, A4, K5, V6
def q_read_fallback(spark, d):
    """The first existing path wins (a missing nested path falls back)."""
    c = io.read_table(spark, [f"{d}/nested/customer.parquet", f"{d}/customer.parquet"])
    return c.select("c_custkey", "c_acctbal", "c_mktsegment")


def q_write_predictions(spark, d):
    """S3: predictions written as CSV with a header to the shared folder and
    read back with an explicit schema (no inference pass)."""
    from ..session import owned_path
    path = owned_path(spark, "predictions")
    io.write_predictions(q_score_table(spark, d), path, key="p_partkey", target="prediction")
    return io.read_table(spark, [path], schema="p_partkey long, prediction double", fmt="csv")


def q_corr_submatrix(spark, d):
    m = explore.corr_submatrix(_t(spark, d, "lineitem"), LI_NUM, ["l_quantity", "l_extendedprice"])
    return m.select("a", "b", _r(F.col("r")).alias("r"))


def _early_stopped(spark, d, c):
    """K5 + M8: one fit with a 10% validation part that stops after ``patience`` trees
    without a lower validation error; the trees up to the lowest are kept."""
    from ..operators import boosting
    t = _ml_frame(spark, d)
    # nested split: its own seed, or it would select a subset of the test rows
    tr = folds.split(t.where("is_test = 0"), "Id", 0.10, seed=43, out="is_valid")
    b = boosting.Boost(c["n_estimators"], c["learning_rate"], c["max_depth"], l1=c.get("l1", 0.0), l2=c.get("l2", 1.0),
                       gamma=c.get("gamma", 0.0), min_child=c.get("min_child", 1.0), patience=c["patience"])
    m = boosting.fit_boosted(tr, b, label="y", key="Id", valid_col="is_valid")
    return _tree_out(m.first(m.best_iteration), t).withColumn("n_trees", F.lit(m.best_iteration))


def q_gbt_early_stop(spark, d):
    from ..operators.maps import EARLY_STOPPED
    return _early_stopped(spark, d, EARLY_STOPPED)


def q_gbt_early_stop_regularized(spark, d):
    from ..operators.maps import EARLY_STOPPED_REGULARIZED
    return _early_stopped(spark, d, EARLY_STOPPED_REGULARIZED)


def q_fit_report(spark, d):
    """V6: parameters and coefficients of a fitted model as rows."""
    p = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    g = linear.gram(p, ["p_size"], "p_retailprice")
    m = linear.fit_bayes_ridge(g, max_iter=300, scale_mask=[True])
    rows = [("alpha_", m.info["alpha_"]), ("lambda_", m.info["lambda_"]), ("n_iter", float(m.info["n_iter"])),
            ("intercept", float(m.intercept))] + [(f, float(w)) for f, w in zip(m.features, m.coef)]
    return spark.createDataFrame(rows, "param string, value double").select(
        "param", _r(F.col("value")).alias("value"))


def q_train_tune_score_all_scope(spark, d):
    """Preprocessing fitted on train + scoring rows (fit_scope='all')."""
    from .workflow import staged_property_split, train_tune_score
    t = staged_property_split(spark, d)
    out, _ = train_tune_score(t.where("is_test = 0").drop("is_test"),
                              t.where("is_test = 1").drop("is_test", "HotelValue"), fit_scope="all")
    return out


QUERIES.update({"read_fallback": q_read_fallback, "write_predictions": q_write_predictions,
                "corr_submatrix": q_corr_submatrix, "gbt_early_stop": q_gbt_early_stop,
                "gbt_early_stop_regularized": q_gbt_early_stop_regularized,
                "fit_report": q_fit_report, "train_tune_score_all_scope": q_train_tune_score_all_scope})


# ------------------------------------------------------------------ the two EDA workflows
def _whole_chain(spark, d, config):
    """Every feature operator at once, numbers rounded (whole ones are round)."""
    from .workflow import wide_property_table
    t = features.engineer(wide_property_table(spark, d), config)

    def out(f):
        if f.dataType.typeName() == "string":
            return F.col(f.name)
        x = F.col(f.name).cast("double")
        return (x if f.dataType.typeName() in ("byte", "short", "integer") else _r(x)).alias(f.name)

    return t.select(*[out(f) for f in t.schema])


def q_engineer_default(spark, d):
    """E1-E10, E13, E14 with the default config, the key's table in and out."""
    return _whole_chain(spark, d, None)


def q_engineer_options(spark, d):
    """Three porch parts, no basement ratio, no renovation repair, L3, the
    quality index, bath count, interaction; correlated columns pruned (P3)."""
    t = _whole_chain(spark, d, {"porch": "3", "basement_ratio": False, "repair": False, "log_list": "L3",
                                "quality_index": "proper", "interaction": True, "bath_count": True,
                                "quality_maps": False, "parking_maps": False, "tree_extra_maps": ["BasementHeight"]})
    return clean.drop_columns(t, maps.MULTICOLLINEAR_DROP)


def q_engineer_keep_originals(spark, d):
    """Derived columns beside untouched originals."""
    return _whole_chain(spark, d, _KEEP_ORIGINALS)


_KEEP_ORIGINALS = {"log_list": "L2", "tree_extra_maps": ["BasementHeight"], "suffix": "_New"}


def q_correlation_eda(spark, d):
    """Correlation workflow: rows trimmed by target quantiles, area and quality
    (P5-P7), features in keep-originals mode (E17), log
    target, numeric columns only (A5), ranked by |r| with the target (A2)."""
    from ..session import stage_table
    from .workflow import property_table, widened
    t = property_table(spark, d)
    # the passes of the quantiles scan the staged target, not the join
    target = stage_table(t.select("HotelValue"), "target")
    t = clean.clean_rows(widened(t), "HotelValue", maps.TARGET_TRIM, "UsableArea",
                         maps.USABLE_AREA_CAP, clean.exclusion_rule("c"), measured=target)
    t = features.engineer(t, _KEEP_ORIGINALS)
    t = t.withColumn("HotelValue_Log", features.target_forward("HotelValue")).drop("HotelValue")
    num, _ = clean.columns_by_role(t, exclude=["Id"])
    r = explore.corr_rank(t, num, "HotelValue_Log")
    return r.select("feature", _r(F.col("r")).alias("r"), "rank")


def q_outlier_eda(spark, d):
    """Box-plot workflow: categorical columns with 2..50 levels (A7), then
    per-level box statistics of the target (A8/A9), one table."""
    from ..session import stage_table
    from .workflow import property_table
    t = property_table(spark, d)
    _, cat = clean.columns_by_role(t, exclude=["Id"])
    # joined once, the used columns only: the gate and every pass of the quantiles scan them
    t = stage_table(t.select("HotelValue", *cat), "property")
    gate = [g["column"] for g in explore.cardinality(t, cat).where("kept = 1").collect()]  # one row per column
    b = explore.box_stats_by_columns(t, gate, "HotelValue")
    return b.select("column", "level", *[_r(F.col(c), 4).alias(c) for c in
                                        ["q1", "median", "q3", "whisker_lo", "whisker_hi"]], "n", "n_fliers")


QUERIES.update({"correlation_eda": q_correlation_eda, "outlier_eda": q_outlier_eda,
                "engineer_default": q_engineer_default, "engineer_options": q_engineer_options,
                "engineer_keep_originals": q_engineer_keep_originals})


# ------------------------------------------------------------------ wide sparse designs
def q_sparse_ridge(spark, d):
    """T5 + M2: one-hot of every part number, ridge by conjugate gradients."""
    from ..operators import sparse
    li = _t(spark, d, "lineitem").select("l_partkey", (F.col("l_extendedprice") / 1000.0).alias("y"))
    design = sparse.fit_design(li, categorical=["l_partkey"])
    m, = sparse.fit_sparse_ridge(sparse.stage_rows(li, design, "y"), design, [5.0])
    return m.level_effects().select(F.col("level").cast("long").alias("l_partkey"), "n",
                                    _r(F.col("coef"), 6).alias("coef"), _r(F.lit(m.intercept), 6).alias("intercept"))


def q_sparse_ridge_search(spark, d):
    """T5 + H1: the same design, penalties x 5 folds from shared passes."""
    from ..operators import sparse
    li = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                         (F.col("l_extendedprice") / 1000.0).alias("y"))
    li = li.withColumn("fold", hash_bucket(_li_key(), 5))
    s = sparse.search_sparse_ridge(li, "y", "fold", [0.5, 5.0, 50.0, 500.0], categorical=["l_partkey"])
    return s.select("alpha", "fold", "n", _r(F.col("rmse"), 6).alias("rmse"))


def q_sparse_polynomial(spark, d):
    """Degree 2 over numbers and one-hots together, terms made in the tasks."""
    from ..operators import sparse
    li = _t(spark, d, "lineitem").withColumn("fold", hash_bucket(_li_key(), 3)).withColumn(
        "y", F.col("l_extendedprice") / 1000.0)
    s = sparse.search_sparse_ridge(li, "y", "fold", [1.0, 100.0], numeric=["l_quantity", "l_discount", "l_tax"],
                                   categorical=["l_returnflag", "l_linestatus"], degree=2, tol=1e-8)
    return s.select("alpha", "fold", "n", _r(F.col("rmse"), 4).alias("rmse"))


QUERIES.update({"sparse_ridge": q_sparse_ridge, "sparse_ridge_search": q_sparse_ridge_search,
                "sparse_polynomial": q_sparse_polynomial})
