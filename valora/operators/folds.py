"""Splits and folds (K1-K5).  Assignment depends only on the key value and the
seed (an md5 bucket), never on partitioning or row order, so it is identical
on any cluster size and reproducible in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import DEFAULT_SEED, hash_bucket, hash_unit
from ..functions.ranking import global_index

_SPLIT_RESOLUTION = 10_000


def split(df: DataFrame, key: str, test_fraction: float = 0.15, seed: int = DEFAULT_SEED,
          out: str = "is_test") -> DataFrame:
    """K1/K5: ``out`` = 1 for about ``test_fraction`` of the keys, else 0.
    A split nested inside another split must use a different ``seed``
    (with the same seed it would pick a subset of the outer test rows)."""
    cut = int(round(test_fraction * _SPLIT_RESOLUTION))
    return df.withColumn(out, (hash_bucket(key, _SPLIT_RESOLUTION, seed) < F.lit(cut)).cast("int"))


def assign_folds(df: DataFrame, key: str, k: int = 5, seed: int = DEFAULT_SEED,
                 out: str = "fold") -> DataFrame:
    """K2: shuffled k-fold id in [0, k)."""
    return df.withColumn(out, hash_bucket(key, k, seed))


def block_folds(df: DataFrame, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """K3: contiguous folds in ``key`` order, sizes as an unshuffled k-fold:
    the first ``n % k`` folds get one extra row.  Only the keys are sorted
    (range-partitioned, no single-partition window): the k - 1 keys at which a
    fold begins settle the rows by comparison.  Rows that share such a key are
    numbered apart."""
    idx = global_index(df.select(F.col(key).alias("__key")), ["__key"], name="__pos")
    n = idx.count()
    q, r = divmod(n, k)
    starts = [i * q + min(i, r) for i in range(1, k)]
    first = {p["__pos"]: p["__key"] for p in idx.where(F.col("__pos").isin(starts)).collect()}  # k - 1 rows
    at = [(s, first[s]) for s in starts if s in first]
    kind = df.schema[key].dataType

    def fold_of(pos):
        fold = F.lit(0)
        for s, _ in at:
            fold = fold + (pos >= F.lit(s)).cast("int")
        return fold

    # null keys come first, as in the sort; a row at a unique first key is in the fold that begins there
    fold = F.lit(0)
    for _, v in at:
        fold = fold + (F.col(key).isNotNull() if v is None else F.coalesce(F.col(key) >= F.lit(v).cast(kind), F.lit(False))).cast("int")
    shared = (idx.where(_among(F.col("__key"), [v for _, v in at], kind)).groupBy("__key")
              .agg(F.count(F.lit(1)).alias("n"), F.min("__pos").alias("from")).where("n > 1").collect())  # under k rows
    if not shared:
        return df.withColumn(out, fold)
    where_from = F.lit(None).cast("long")
    for v in shared:
        where_from = F.when(F.col(key).eqNullSafe(F.lit(v["__key"]).cast(kind)), F.lit(v["from"])).otherwise(where_from)
    numbered = F.row_number().over(Window.partitionBy(key).orderBy(key)) - 1
    one = df.where(where_from.isNull()).withColumn(out, fold)
    many = df.where(where_from.isNotNull()).withColumn("__nth", numbered)
    return one.unionByName(many.withColumn(out, fold_of(where_from + F.col("__nth"))).drop("__nth"))


def _among(col, values, kind):
    got = F.lit(False)
    for v in values:
        got = got | col.eqNullSafe(F.lit(v).cast(kind))
    return got


def leave_one_out_folds(df: DataFrame, key: str, out: str = "fold") -> DataFrame:
    """K4 as folds: every row its own fold (only for the brute-force check;
    the linear family uses the closed-form leverage instead)."""
    return df.withColumn(out, F.col(key))


def hash_value(key: str, seed: int = DEFAULT_SEED):
    return hash_unit(key, seed)
