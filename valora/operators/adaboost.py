"""AdaBoost.R2 (Drucker 1997) on staged one-byte features.

Weights go to the trees (deterministic) in place of weighted resampling.  The
rows are kept by the executors as blocks with their present weights, which are
renewed in the first pass of the next round and checkpointed every
``boosting.STAGE_TREES`` rounds.  A table within one broadcast is fitted by one task, and the
candidates and folds of a search run side by side.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting
from .boosting import BINS, Boost, NumpyRows, _codes, binned, blocks, grow_tree, routed
from .forest import BROADCAST_BYTES, Tree

LOSSES = ("linear", "square", "exponential")


@dataclass(frozen=True)
class Ada:
    n_estimators: int = 50
    learning_rate: float = 1.0
    loss: str = "linear"
    max_depth: int | None = 3

    def __post_init__(self):
        if self.loss not in LOSSES:
            raise ValueError(f"loss {self.loss!r} is none of {LOSSES}")

    @property
    def tree(self) -> Boost:
        """Least squares: leaves are weighted means."""
        return Boost(1, 1.0, self.max_depth, l2=0.0, min_child=1e-9)

    def lost(self, e: np.ndarray) -> np.ndarray:
        """Loss of errors that are shares of the largest."""
        return e if self.loss == "linear" else e * e if self.loss == "square" else 1 - np.exp(-e)

    def factor(self, e: np.ndarray, beta: float) -> np.ndarray:
        return beta ** ((1 - self.lost(e)) * self.learning_rate)


@dataclass
class AdaModel:
    trees: list[Tree]
    weights: list[float]
    features_col: str = "features"

    def first(self, k: int) -> AdaModel:
        return replace(self, trees=self.trees[:k], weights=self.weights[:k])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted median of the trees."""
        if not len(x):
            return np.zeros(0)
        out = np.empty(len(x))
        w = np.asarray(self.weights)
        step = max(1, (4 << 20) // len(w))
        for at in range(0, len(x), step):
            p = np.stack([t.walk(x[at:at + step])[0][0] for t in self.trees], axis=1)
            order = np.argsort(p, axis=1, kind="stable")
            upto = np.cumsum(w[order], axis=1)
            pick = (upto >= 0.5 * upto[:, -1:]).argmax(axis=1)
            rows = np.arange(len(p))
            out[at:at + step] = p[rows, order[rows, pick]]
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self)  # trees of bounded depth

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(held.value.predict(np.stack(x.to_numpy())))

        return df.withColumn(out, score(vector_to_array(F.col(self.features_col))))

    def dumps(self) -> bytes:
        return pickle.dumps(([t.dumps() for t in self.trees], self.weights))

    @staticmethod
    def loads(data: bytes) -> AdaModel:
        trees, weights = pickle.loads(data)
        return AdaModel([Tree.loads(t) for t in trees], weights)


def _run(a: Ada, one_tree, measure, advance) -> AdaModel:
    """The rounds.  ``one_tree()`` fits, ``measure()`` gives (largest error, mean
    weighted loss), ``advance(beta, largest)`` changes the weights."""
    trees, weights = [], []
    for _ in range(a.n_estimators):
        tree = one_tree()
        largest, loss = measure(tree)
        if largest <= 0 or loss <= 0:  # a perfect learner: keep it and stop
            trees.append(tree)
            weights.append(1.0)
            break
        if loss >= 0.5:
            if not trees:
                trees.append(tree)
                weights.append(1.0)
            break
        beta = loss / (1 - loss)
        trees.append(tree)
        weights.append(a.learning_rate * math.log(1 / beta))
        advance(tree, beta, largest)
    return AdaModel(trees, weights)


def fit_arrays(codes: np.ndarray, y: np.ndarray, train: np.ndarray, edges: np.ndarray, a: Ada) -> AdaModel:
    """A whole fit in numpy on the rows of ``train``."""
    codes, y = codes[train], y[train]
    source, columns = NumpyRows(codes, edges.shape[1] + 1), np.arange(codes.shape[1])
    use = np.ones(len(y), bool)
    state = {"w": np.ones(len(y)), "e": None}

    def one_tree() -> Tree:
        source.begin(columns, -state["w"] * y, state["w"], use)
        return grow_tree(source, edges, columns, a.tree)

    def measure(tree: Tree) -> tuple[float, float]:
        e = state["e"] = np.abs(tree.value[source.at] - y)
        largest = float(e.max())
        return largest, float(np.average(a.lost(e / largest), weights=state["w"])) if largest > 0 else 0.0

    def advance(tree: Tree, beta: float, largest: float) -> None:
        w = state["w"] * a.factor(state["e"] / largest, beta)
        state["w"] = w / w.mean()

    return _run(a, one_tree, measure, advance)


class _Weighted(boosting.Passes):
    """The :func:`boosting.blocks` with their weights as a source of histograms; rows
    whose part is ``out`` are left out."""

    def __init__(self, kept: RDD, edges: np.ndarray, a: Ada, out: int | None):
        def start(block: tuple) -> tuple:
            codes, y, part, _ = block
            if out is not None:
                codes, y = np.ascontiguousarray(codes[:, part != out]), y[part != out]
            return codes, y, np.ones(len(y))

        super().__init__(kept.map(start), edges)
        self.a, self.rounds = a, 0
        self.rows_count = self.state.map(lambda s: len(s[1])).sum()

    def reader(self, root: bool):
        def read(block: tuple) -> tuple:
            codes, y, w = block

            def gradients(use: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
                own, yours = (w, y) if use is None else (w[use], y[use])
                return -own * yours, own

            return codes, gradients, None, 0.0

        return read

    def measure(self, tree: Tree) -> tuple[float, float]:
        splits, total, a = self.splits, self.nodes, self.a

        def sums(largest: float | None) -> tuple[float, np.ndarray]:
            """Largest error, sum of weights, and sums of the weighted losses: of the
            errors, of their squares and, once the largest is known, of their shares."""
            def task(state: Iterator[tuple]) -> Iterator[tuple]:
                most, out = 0.0, np.zeros(4)
                for codes, y, w in state:
                    e = np.abs(tree.value[routed(codes, splits, total)] - y)
                    most = max(most, float(e.max(initial=0.0)))
                    out += w.sum(), w @ e, w @ (e * e), w @ a.lost(e / largest) if largest else 0.0
                yield most, out

            got = self.state.mapPartitions(task).collect()  # a row a task
            return max(m for m, _ in got), np.sum([s for _, s in got], axis=0)

        most, (weight, e, ee, _) = sums(None)
        if not most:
            return 0.0, 0.0
        lost = e / most if a.loss == "linear" else ee / most / most if a.loss == "square" else sums(most)[1][-1]
        self.weight = weight
        return most, float(lost / weight)

    def advance(self, tree: Tree, beta: float, largest: float) -> None:
        splits, total, a = self.splits, self.nodes, self.a
        scale = self.rows_count / self.weight  # keeps weights near one: their sum goes back to the number of rows
        self.rounds += 1
        self.renew(lambda s: (s[0], s[1], s[2] * (scale * a.factor(np.abs(tree.value[routed(s[0], splits, total)] - s[1]) / largest, beta))),
                   self.rounds % boosting.STAGE_TREES == 0)


def fit_cluster(kept: RDD, edges: np.ndarray, a: Ada, out: int | None = None, last: bool = False) -> AdaModel:
    """A fit by passes over the :func:`boosting.blocks` but those of the part ``out``.  The
    ``last`` fit of the blocks lets go of them once its own state is kept."""
    source, columns = _Weighted(kept, edges, a, out), np.arange(len(edges))

    def one_tree() -> Tree:
        source.begin(columns)
        first = source.histograms([0])
        if last and source.rounds:
            kept.unpersist()
        return grow_tree(source, edges, columns, a.tree, first)

    try:
        return _run(a, one_tree, source.measure, source.advance)
    finally:
        source.release()


def _local(rows: DataFrame):
    got = rows.toArrow().combine_chunks()
    keys, y = got["key"].to_numpy(), got["y"].to_numpy()
    order = np.lexsort((y, keys))
    return _codes(got["codes"].combine_chunks())[order], y[order], got["part"].to_numpy()[order]


def fit_adaboost(df: DataFrame, a: Ada, features_col: str = "features", label: str = "label", key: str | None = None,
                 bins: int = BINS, broadcast_bytes: int = BROADCAST_BYTES) -> AdaModel:
    """Fit on the rows with a label."""
    rows, edges = binned(df, features_col, label, key, None, bins)
    if rows.count() * (len(edges) + 24) > broadcast_bytes:
        kept = blocks(rows, edges, False, False)
        try:
            return replace(fit_cluster(kept, edges, a, last=True), features_col=features_col)
        finally:
            kept.unpersist()
    held = rows.sparkSession.sparkContext.broadcast(_local(rows))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, y, _ = held.value
        for _ in batches:
            model = fit_arrays(codes, y, np.ones(len(y), bool), edges, a)
            yield pa.RecordBatch.from_arrays([pa.array([model.dumps()], pa.binary())], ["model"])

    one = rows.sparkSession.range(0, 1, 1, 1).mapInArrow(task, "model binary").first()
    return replace(AdaModel.loads(one["model"]), features_col=features_col)


def cross_validate(df: DataFrame, candidates: list[Ada], fold_col: str, k: int, features_col: str = "features",
                   label: str = "label", key: str | None = None, bins: int = BINS, broadcast_bytes: int = BROADCAST_BYTES) -> list[float]:
    """Mean RMSE over the folds.  Candidates that differ in the number of trees only
    share one fit a fold."""
    rows, edges = binned(df, features_col, label, key, fold_col, bins)
    spark = rows.sparkSession
    if rows.select("part").distinct().count() != k:
        raise ValueError("a fold without rows: no score to choose by")
    groups: dict[Ada, list[int]] = {}
    for i, c in enumerate(candidates):
        groups.setdefault(replace(c, n_estimators=0), []).append(i)
    jobs = [(replace(a, n_estimators=max(candidates[i].n_estimators for i in own)), own, f) for a, own in groups.items() for f in range(k)]
    # bins stand for their values: code c is met by edge c, the last by infinity
    upper = np.concatenate([edges, np.full((len(edges), 1), np.inf)], axis=1)

    def errors(model: AdaModel, codes: np.ndarray, y: np.ndarray, own: list[int]) -> list[float]:
        x = np.stack([upper[f][codes[:, f]] for f in range(codes.shape[1])], axis=1)
        return [float(((model.first(candidates[i].n_estimators).predict(x) - y) ** 2).sum()) for i in own]

    sse: dict[tuple[int, int], tuple[float, int]] = {}
    if rows.count() * (len(edges) + 24) <= broadcast_bytes:
        held = spark.sparkContext.broadcast(_local(rows))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, y, part = held.value
            for batch in batches:
                for j in batch.column(0).to_pylist():
                    a, own, f = jobs[j]
                    model, test = fit_arrays(codes, y, part != f, edges, a), part == f
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([j], pa.int64()), pa.array([errors(model, codes[test], y[test], own)], pa.list_(pa.float64())), pa.array([int(test.sum())])],
                        ["j", "sse", "n"])

        ranked = sorted(range(len(jobs)), key=lambda j: -jobs[j][0].n_estimators * (jobs[j][0].max_depth or 8))
        numbers = spark.createDataFrame([(j,) for j in ranked], "id long").repartition(len(jobs))
        for r in numbers.mapInArrow(task, "j long, sse array<double>, n long").collect():
            for i, e in zip(jobs[r["j"]][1], r["sse"], strict=True):
                sse[i, jobs[r["j"]][2]] = e, r["n"]
    else:
        kept = blocks(rows, edges, True, False)
        for j, (a, own, f) in enumerate(jobs):
            model = fit_cluster(kept, edges, a, f, j == len(jobs) - 1)

            def task(batches: Iterator[pa.RecordBatch], model=model, own=own) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if batch.num_rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([errors(model, _codes(batch.column(1)), batch.column(2).to_numpy(), own)], pa.list_(pa.float64())),
                             pa.array([batch.num_rows])], ["sse", "n"])

            got = rows.where(F.col("part") == f).mapInArrow(task, "sse array<double>, n long").agg(
                *[F.sum(F.col("sse")[q]) for q in range(len(own))], F.sum("n")).first()
            for q, i in enumerate(own):
                sse[i, f] = got[q], got[-1]
        kept.unpersist()
    return [float(np.mean([math.sqrt(sse[i, f][0] / sse[i, f][1]) for f in range(k)])) for i in range(len(candidates))]
