import numpy as np
import pytest

from valora.functions import exact_quantiles, global_index, medians
from valora.functions.quantiles import column_quantiles


def test_even_count_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert exact_quantiles(df, "x", [0.5])[0.5] == 2.5


def test_skewed_hot_value_matches_numpy(spark):
    rng = np.random.default_rng(0)
    vals = np.concatenate([np.full(3000, 7.0), rng.lognormal(3, 2, 6000)])
    df = spark.createDataFrame([(float(v),) for v in vals], "x double").repartition(8)
    probs = [0.001, 0.25, 0.5, 0.77, 0.999]
    got = exact_quantiles(df, "x", probs, buckets=16, leaf_rows=50)  # forces several passes
    for q in probs:
        assert got[q] == pytest.approx(np.quantile(vals, q), rel=1e-12)


def test_grouped_with_passes_matches_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(v)) for v in rng.normal(0, 1, 3000)] + \
           [("cold", float(v)) for v in rng.exponential(5, 700)] + [(None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    probs = [0.25, 0.5, 0.75]
    got = exact_quantiles(df, "x", probs, by=["g"], buckets=8, leaf_rows=40).collect()
    assert {r["g"] for r in got} == {"hot", "cold"}  # null key dropped
    for r in got:
        ref = np.array([x for g, x in rows if g == r["g"]])
        assert r["quantile"] == pytest.approx(np.quantile(ref, r["prob"]), rel=1e-12)


def test_grouped_fast_path(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0), ("b", 9.0)], "g string, x double")
    got = {r["g"]: r["quantile"] for r in exact_quantiles(df, "x", [0.5], by="g").collect()}
    assert got == {"a": 2.0, "b": 5.0}


def test_value_on_quantile_is_kept(spark):
    from valora.operators.clean import quantile_trim
    df = spark.createDataFrame([(float(i),) for i in range(1001)], "y double")
    out = quantile_trim(df, "y", 0.001, 0.999)  # q(0.001)=1.0, q(0.999)=999.0 exactly
    assert out.count() == 999


def test_medians_multi_column_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None, 4.0), (2.0, None, 4.0), (9.0, None, 4.0)], "a double, b double, c double")
    assert medians(df, ["a", "b", "c"]) == {"a": 2.0, "b": None, "c": 4.0}
    q = column_quantiles(df, ["a"], [0.0, 1.0])
    assert q["a"] == {0.0: 1.0, 1.0: 9.0}


def test_partition_invariance(spark):
    rng = np.random.default_rng(2)
    rows = [(float(v),) for v in rng.normal(size=2000)]
    a = exact_quantiles(spark.createDataFrame(rows, "x double").coalesce(1), "x", [0.1, 0.9], leaf_rows=30)
    b = exact_quantiles(spark.createDataFrame(rows, "x double").repartition(8), "x", [0.1, 0.9], leaf_rows=30)
    assert a == b


def test_global_index_dense_positions(spark):
    df = spark.range(0, 5000).selectExpr("id * 3 AS k").repartition(7)
    out = global_index(df, ["k"], name="pos")
    assert out.where("pos * 3 != k").count() == 0
    assert out.count() == 5000
