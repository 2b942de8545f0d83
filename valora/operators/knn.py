"""k-nearest-neighbour regression (M11), exact.

Both sides are packed by Spark into matrices of bounded size, of rows that lie
close along one direction, and met block by block; no row pair is ever a row of
a table, and nothing passes through the driver.  For a pair of blocks one matrix
product gives all squared distances; the rows that can be among the nearest,
with a margin for rounding, are measured again exactly (of manhattan distances
first by whole numbers of steps, with a margin of a step a coordinate), so zeros and ties at the
k-th distance are settled as by plain subtraction.  A block whose centre is
farther from a query than its radius plus the query's k-th distance so far is
skipped (triangle inequality).  A task keeps a running top-k of the queries in
hand and sends on at most k rows a query."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_parallelism, owned_path

#: Cells of a distance matrix held at a time, and rows of a block.
_CELLS, _BLOCK_ROWS = 1 << 17, 8192


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT
    if isinstance(df.schema[vec].dataType, VectorUDT):
        return df.withColumn(vec, vector_to_array(F.col(vec)))
    return df.withColumn(vec, F.col(vec).cast("array<double>"))


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Row by row."""
    return np.abs(a - b).sum(axis=1) if metric == "manhattan" else np.sqrt(((a - b) ** 2).sum(axis=1))


def _whole(x: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float] | None:
    """Both sides' coordinates as whole numbers of steps from the lowest, such that the
    sum of a row's is a uint16; none if a value isn't finite."""
    d = b.shape[1]
    low, high = np.minimum(x.min(axis=0), b.min(axis=0)), np.maximum(x.max(axis=0), b.max(axis=0))
    top = 65535 // d
    step = float((high - low).max()) / top if top else math.nan
    if not math.isfinite(step):
        return None
    step = step or 1.0
    qx, qb = (np.minimum((v - low) / step, top).astype(np.uint16) for v in (x, b))
    return qx, qb, step


def _steps_apart(qx: np.ndarray, qb: np.ndarray) -> np.ndarray:
    """Sums of |a - b| over the coordinates of whole numbers, as 2 max(a, b) - a - b:
    one number takes a quarter of a double's room in the vector units."""
    most, one = np.zeros((len(qx), len(qb)), np.uint16), np.empty((len(qx), len(qb)), np.uint16)
    columns = np.ascontiguousarray(qb.T)
    for f in range(qb.shape[1]):  # tiles that stay in a core's cache
        np.maximum(qx[:, f, None], columns[f][None, :], out=one)
        most += one
    out = most.astype(np.int32)
    out *= 2
    out -= qx.sum(axis=1, dtype=np.int32)[:, None]
    out -= qb.sum(axis=1, dtype=np.int32)[None, :]
    return out


def _packed(rows: DataFrame, d: int, block_rows: int, metric: str) -> DataFrame:
    """Rows (key, x array, y double) as blocks (id, keys, x, y, centre, radius), the
    matrices as bytes; rows are dealt by range along one direction."""
    spark = rows.sparkSession
    key = rows.schema["key"].dataType.simpleString()
    # the direction (1, 1/2, 1/3, ...): any would do
    along = F.aggregate(F.transform("x", lambda v, i: v / (i + 1)), F.lit(0.0), lambda s, v: s + v)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("__along", along).repartitionByRange(parts, "__along", "key").sortWithinPartitions("__along", "key").drop("__along")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, d)
                centre = x.mean(axis=0)
                far = _distances(x, centre[None, :], metric).max()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0)),
                     pa.array([x.tobytes()]), pa.array([part.column(2).to_numpy(zero_copy_only=False).astype(np.float64).tobytes()]),
                     pa.array([centre.tobytes()]), pa.array([float(far)])], ["id", "keys", "x", "y", "centre", "radius"])
                number += 1

    path = owned_path(spark, "knn-blocks")
    dealt.mapInArrow(pack, f"id long, keys array<{key}>, x binary, y binary, centre binary, radius double").write.parquet(path)
    return spark.read.parquet(path)


def _sortable(values: pa.Array) -> np.ndarray:
    out = values.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


class _Nearest:
    """Running top-k of the queries of a block."""

    def __init__(self, keys: pa.Array, x: np.ndarray, k: int, metric: str):
        self.keys, self.x, self.k, self.metric = keys, x, k, metric
        self.kth = np.full(len(x), np.inf)
        self.row = np.zeros(0, np.int64)  # query, distance, base key, label of what is kept
        self.dist, self.base, self.label = np.zeros(0), None, np.zeros(0)
        self.norm = (x * x).sum(axis=1)

    def meet(self, keys: np.ndarray, b: np.ndarray, y: np.ndarray, centre: np.ndarray, radius: float) -> None:
        reach = _distances(self.x, centre[None, :], self.metric) - radius
        # a little slack for rounding, and ties at the k-th distance stay in; NaN never is skipped
        want = np.flatnonzero(~(reach * (1 - 1e-9) - 1e-12 > self.kth))
        columns = np.ascontiguousarray(b.T)
        norm = np.abs(b).sum(axis=1) if self.metric == "manhattan" else (b * b).sum(axis=1)
        tile = max(1, _CELLS // len(b))
        whole = _whole(self.x[want], b) if self.metric == "manhattan" and len(want) else None
        found = []
        for at in range(0, len(want), tile):
            rows = want[at:at + tile]
            got = None if whole is None else self._coarse(rows, whole[0][at:at + tile], *whole[1:])
            found.append(got or self._candidates(rows, b, columns, norm))
        if not found:
            return
        i, j = (np.concatenate(v) for v in zip(*found, strict=True))
        step = max(1, 8 * _CELLS // max(1, b.shape[1]))
        dist = np.concatenate([_distances(self.x[i[q:q + step]], b[j[q:q + step]], self.metric) for q in range(0, len(i), step)] or [np.zeros(0)])
        near = ~(dist > self.kth[i])
        i, j, dist = i[near], j[near], dist[near]
        row, dist = np.concatenate([self.row, i]), np.concatenate([self.dist, dist])
        base = keys[j] if self.base is None else np.concatenate([self.base, keys[j]])
        label = np.concatenate([self.label, y[j]])
        order = np.lexsort((base, dist, row))
        row = row[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        keep = rank < self.k
        self.row, order = row[keep], order[keep]
        self.dist, self.base, self.label = dist[order], base[order], label[order]
        last = rank[keep] == self.k - 1
        self.kth[self.row[last]] = self.dist[last]

    def _candidates(self, rows: np.ndarray, b: np.ndarray, columns: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, base row) of all that may be among the nearest; ``norm`` by base row:
        its squared length, or its length in the metric."""
        x, k = self.x[rows], min(self.k, len(b))
        if self.metric == "manhattan":
            near, one = np.zeros((len(x), len(b))), np.empty((len(x), len(b)))
            for f in range(b.shape[1]):  # tiles that stay in a core's cache
                np.subtract(x[:, f, None], columns[f][None, :], out=one)
                np.abs(one, out=one)
                near += one
            bound, slack = self.kth[rows], 1e-9 * (1 + np.abs(x).sum(axis=1) + norm.max())
        else:
            near = (-2.0 * x) @ columns
            near += self.norm[rows, None]
            near += norm[None, :]
            bound, slack = self.kth[rows] ** 2, 1e-9 * (1 + self.norm[rows] + norm.max())
        at = np.flatnonzero(near <= (bound + slack)[:, None])
        if len(at) > 2 * k * len(x):  # the bound says little yet
            kth = np.partition(near, k - 1, axis=1)[:, k - 1]
            at = np.flatnonzero(near <= (np.minimum(kth, bound) + slack)[:, None])
        i, j = np.divmod(at, len(b))
        return rows[i], j

    def _coarse(self, rows: np.ndarray, qx: np.ndarray, qb: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray] | None:
        """:meth:`_candidates` by whole numbers of steps, which differ from the distance
        by less than a step a coordinate; None if they part too little."""
        k, slack = min(self.k, len(qb)), qb.shape[1] + 2
        near = _steps_apart(qx, qb)
        bound = np.minimum(np.floor(self.kth[rows] / step) + slack, 1 << 30).astype(np.int32)
        at = np.flatnonzero(near <= bound[:, None])
        if len(at) > 2 * k * len(rows):
            kth = np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * slack
            at = np.flatnonzero(near <= np.minimum(kth, bound)[:, None])
            if len(at) > max(near.size // 8, 4 * k * len(rows)):
                return None
        i, j = np.divmod(at, len(qb))
        return rows[i], j

    def batch(self) -> pa.RecordBatch:
        base = self.base if self.base is not None else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays(
            [self.keys.take(pa.array(self.row)), pa.array(base), pa.array(self.label), pa.array(self.dist)], ["key", "nb_key", "nb_label", "dist"])


def knn_neighbours(query: DataFrame, base: DataFrame, key: str, vec: str, label: str,
                   k: int = 10, metric: str = "euclidean", chunk_bytes: int = 1 << 20,
                   base_key: str | None = None) -> DataFrame:
    """Top-``k`` base rows per query row: ``(key, nb_key, nb_label, dist, nb_rank)``,
    ties broken by the base key (deterministic).  A block holds at most
    ``chunk_bytes`` of vectors; a task one block of either side and the top-k."""
    base_key = base_key or key
    q = _vectors(query.select(F.col(key).alias("key"), F.col(vec).alias("x")), "x").withColumn("y", F.lit(0.0))
    b = _vectors(base.select(F.col(base_key).alias("key"), F.col(vec).alias("x"), F.col(label).cast("double").alias("y")), "x")
    stats = b.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    if not stats["n"]:
        raise ValueError("empty base table")
    d = int(stats["d"])
    rows = max(1, min(_BLOCK_ROWS, chunk_bytes // (8 * (d + 2))))
    key_type, bk_type = (f.schema["key"].dataType.simpleString() for f in (q, b))
    queries = ensure_parallelism(_packed(q, d, rows, metric).select("id", F.col("keys").alias("q_keys"), F.col("x").alias("q_x")))
    blocks = _packed(b, d, rows, metric).select("keys", "x", "y", "centre", "radius")

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for number, q_keys, q_x, keys, x, y, centre, radius in zip(*batch.columns, strict=True):
                if number.as_py() != at:
                    if held is not None:
                        yield held.batch()
                    at, held = number.as_py(), _Nearest(q_keys.values, np.frombuffer(q_x.as_buffer()).reshape(-1, d), k, metric)
                held.meet(_sortable(keys.values), np.frombuffer(x.as_buffer()).reshape(-1, d), np.frombuffer(y.as_buffer()),
                          np.frombuffer(centre.as_buffer()), radius.as_py())
        if held is not None:
            yield held.batch()

    # a query block meets every base block: blocks, not rows
    found = queries.crossJoin(blocks).mapInArrow(nearest, f"key {key_type}, nb_key {bk_type}, nb_label double, dist double")
    w = Window.partitionBy("key").orderBy("dist", "nb_key")  # at most k rows a key and task
    return (found.withColumn("nb_rank", F.row_number().over(w)).where(F.col("nb_rank") <= k)
            .withColumnRenamed("key", key))


def _predictions(k: int, weights: str):
    """Prediction from the ``k`` nearest as one aggregate expression over a query
    row's ranked neighbours."""
    near = F.col("nb_rank") <= k
    if weights == "uniform":
        return F.avg(F.when(near, F.col("nb_label")))
    zero = near & (F.col("dist") == 0)
    far = near & (F.col("dist") != 0)
    exact = F.avg(F.when(zero, F.col("nb_label")))
    return F.coalesce(exact, F.sum(F.when(far, F.col("nb_label") / F.col("dist")))
                      / F.sum(F.when(far, 1.0 / F.col("dist"))))


def knn_regress(query: DataFrame, base: DataFrame, key: str, vec: str, label: str, k: int = 5,
                weights: str = "uniform", metric: str = "euclidean",
                neighbours: DataFrame | None = None) -> DataFrame:
    """Prediction per query row: mean label of the k nearest (``uniform``) or
    the 1/d-weighted mean (``distance``; if any neighbour is at distance 0,
    only those count).  Pass precomputed top-K ``neighbours`` (K >= k) to
    derive every k from one search."""
    nb = neighbours if neighbours is not None else knn_neighbours(query, base, key, vec, label, k, metric)
    return nb.groupBy(key).agg(_predictions(k, weights).alias("prediction"))


def knn_grid(query: DataFrame, base: DataFrame, key: str, vec: str, label: str, y: str,
             ks=(3, 5, 7, 10), metrics=("euclidean", "manhattan"),
             weights=("uniform", "distance")) -> DataFrame:
    """H1 for k-NN: one top-max(k) search per metric; every (k, weights) is an
    aggregate over its neighbours, all in one pass.  Returns RMSE per (metric,
    k, weights)."""
    truth = query.select(key, F.col(y).cast("double").alias("__y"))
    points = [(kk, w) for kk in ks for w in weights]
    out = None
    for m in metrics:
        nb = knn_neighbours(query, base, key, vec, label, max(ks), m)
        wide = nb.groupBy(key).agg(*[_predictions(kk, w).alias(f"p{i}") for i, (kk, w) in enumerate(points)])
        rmse = wide.join(truth, key).agg(*[F.sqrt(F.avg((F.col(f"p{i}") - F.col("__y")) ** 2)).alias(f"r{i}")
                                           for i in range(len(points))])
        long = rmse.select(F.explode(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.lit(kk).alias("k"), F.lit(w).alias("weights"), F.col(f"r{i}").alias("rmse"))
            for i, (kk, w) in enumerate(points)])).alias("e")).select("e.*")
        out = long if out is None else out.unionByName(long)
    return out
