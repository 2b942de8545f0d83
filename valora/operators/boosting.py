"""M8 / M9 / K5: second-order boosted trees from gradient and hessian histograms.

Features are cut into at most 256 bins once and staged as one byte each.  A tree
grows level by level, or leaf by leaf in order of gain (``max_leaves``); a split
needs the sums of gradient and hessian of one child only, the smaller: those of
its sibling are the parent's less these.  Leaves carry L1 and L2 penalties:
with soft-thresholded gradient sum T(G) a leaf is -T(G) / (H + l2), and a split
gains the sum of T(G)^2 / (H + l2) over its children less that of the node.

The growth code asks a source for histograms.  On the cluster a source is an RDD
of blocks of rows, kept by the executors: one pass gives the histograms of all
small children of a level, added up by the driver or, if they are large, by a
shuffle on the node; of a tree that grows leaf by leaf, those of all leaves that
may still be split.  Columns of few bins are counted together, in cells of their
product, and told apart at the end of a task.  Rows keep a running residual that is
kept anew every ``KEPT_TREES`` trees and checkpointed every ``STAGE_TREES``; the trees
since then are walked in the pass.  The driver holds histograms (leaves x features x bins), which
don't grow with the rows.  A table within the bytes of one broadcast is a numpy source, so a
task fits a whole model and the candidates and folds of a search run side by side.
Both sources give the same trees, up to the rounding of sums.

Rows and columns of a tree are drawn by hashes of (row key, tree) and (tree,
column).  The first ``k`` trees of a model are the model of ``k`` trees, so any
number of trees, early stopping included, is read off one fit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_path, ensure_checkpoint_dir, stage_table
from .forest import BROADCAST_BYTES, Tree, _matrix, _salted, bin_edges, mix64

#: Trees after which the rows' residuals are kept anew, and written to the shared folder.
KEPT_TREES, STAGE_TREES = 1, 64
BINS = 64
#: Rows of a block, and bytes of blocks that a task reads.
BLOCK_ROWS, PARTITION_BYTES = 1 << 16, 256 << 20
#: Bytes of the tasks' histograms that one task adds up.
REDUCED_BYTES = 16 << 20
#: Cells (nodes x bins of columns that are counted together) of a histogram in a core's cache.
JOINT_CELLS = 1 << 16
#: Gains up to this are rounding.
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Boost:
    """``max_leaves`` grows leaf by leaf; ``gamma`` is the least gain of a split,
    ``min_child`` the least sum of hessians (rows) of a child; ``patience`` stops
    after so many trees without a lower validation error."""

    n_trees: int = 100
    rate: float = 0.3
    max_depth: int | None = 6
    max_leaves: int | None = None
    subsample: float = 1.0
    colsample: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    min_child: float = 1.0
    patience: int | None = None
    seed: int = 42

    def columns(self, p: int, tree: int) -> np.ndarray:
        """The columns that a tree may use."""
        m = max(1, min(p, round(self.colsample * p)))
        rank = mix64(np.arange(p, dtype=np.uint64) ^ _salted(self.seed, tree, 7))
        return np.sort(np.argsort(rank, kind="stable")[:m])

    def sampled(self, keys: np.ndarray, tree: int) -> np.ndarray:
        if self.subsample >= 1:
            return np.ones(len(keys), bool)
        u = (mix64(keys.astype(np.int64).view(np.uint64) ^ _salted(self.seed, tree, 11)) >> np.uint64(11)) * (1.0 / (1 << 53))
        return u < self.subsample

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        t = np.maximum(np.abs(g) - self.l1, 0.0)
        return t * t / np.maximum(h + self.l2, 1e-300)

    def leaf(self, g: float, h: float) -> float:
        return -math.copysign(max(abs(g) - self.l1, 0.0), g) / (h + self.l2) if h + self.l2 > 0 else 0.0


def best_splits(hist: np.ndarray, b: Boost) -> list[tuple[float, int, int]]:
    """(gain, column, bin) of each node from its histograms, nodes x 2 x columns x
    bins; ties go to the lower column, then the lower bin."""
    g, h = np.cumsum(hist[:, 0], axis=2)[:, :, :-1], np.cumsum(hist[:, 1], axis=2)[:, :, :-1]
    total_g, total_h = hist[:, 0, :1].sum(2, keepdims=True), hist[:, 1, :1].sum(2, keepdims=True)
    least = max(b.min_child, 1e-12)
    gain = b.score(g, h) + b.score(total_g - g, total_h - h) - b.score(total_g, total_h)
    gain[(h < least) | (total_h - h < least)] = -np.inf
    flat = gain.reshape(len(hist), -1)
    at = np.argmax(flat, axis=1)
    return [(float(flat[i, k]), int(k // gain.shape[2]), int(k % gain.shape[2])) for i, k in enumerate(at)]


def _below(h: np.ndarray, f: int, cut: int) -> bool:
    """Whether the rows up to the cut are the smaller child."""
    return bool(h[1, f, :cut + 1].sum() * 2 <= h[1, f].sum())


def grow_ahead(source, edges: np.ndarray, columns: np.ndarray, b: Boost, first: np.ndarray) -> Tree:
    """The tree that grows leaf by leaf, in about as many passes as it has levels.  How a
    leaf is split doesn't depend on the other leaves, so a pass parts all that would be
    split by what is known so far; some of that may not become part of the tree."""
    sums, splits, below = [], [], {}  # of each node that was met; and its left child, once parted

    def met(hist: np.ndarray) -> None:
        for h, split in zip(hist, best_splits(hist, b), strict=True):
            sums.append(h)
            splits.append(split)

    met(first)
    while True:
        # the tree as known: (met, feature, bin, left, depth) of each node, -1 if not met
        nodes = [[0, -1, 0, 0, 0]]
        value = [b.rate * b.leaf(sums[0][0, 0].sum(), sums[0][1, 0].sum())]
        waiting, leaves, asked = [], 1, []

        def enter(at: int) -> None:
            gain = splits[nodes[at][0]][0]
            if gain > max(b.gamma, LEAST_GAIN) and (b.max_depth is None or nodes[at][4] < b.max_depth):
                heapq.heappush(waiting, (-gain, at))

        enter(0)
        while waiting and leaves < b.max_leaves:
            _, at = heapq.heappop(waiting)
            own, *_, depth = nodes[at]
            _, f, cut = splits[own]
            h, left = sums[own], len(nodes)
            nodes[at][1:4] = f, cut, left
            leaves += 1
            inner = b.max_depth is None or depth + 1 < b.max_depth
            if inner and own not in below:
                asked.append(own)
            total, here = h[:, f].sum(1), h[:, f, :cut + 1].sum(1)
            for child, (g, w) in enumerate((here, total - here)):
                kid = below[own] + child if own in below else -1
                nodes.append([kid, -1, 0, 0, depth + 1])
                if kid >= 0:
                    g, w = sums[kid][0, 0].sum(), sums[kid][1, 0].sum()
                value.append(b.rate * b.leaf(g, w))
                if kid >= 0:
                    enter(left + child)
        if not asked:
            break
        small = []
        for i, own in enumerate(asked):
            below[own] = len(sums) + 2 * i
            _, f, cut = splits[own]
            small.append(below[own] + (not _below(sums[own], f, cut)))
        source.split([(own, int(columns[splits[own][1]]), splits[own][2], below[own]) for own in asked], len(sums) + 2 * len(asked))
        for own, s, got in zip(asked, small, source.histograms(small), strict=True):
            rest = sums[own] - got
            met(np.stack([got, rest] if s == below[own] else [rest, got]))
    source.begin(columns)  # what the tree didn't use is gone
    done = [(at, int(columns[f]), cut, left) for at, (_, f, cut, left, _) in enumerate(nodes) if f >= 0]
    if done:
        source.split(sorted(done, key=lambda s: s[3]), len(nodes))
    feature = np.array([columns[f] if f >= 0 else -1 for _, f, *_ in nodes], np.int16)
    threshold = np.array([edges[columns[f], cut] if f >= 0 else 0.0 for _, f, cut, *_ in nodes])
    return Tree(feature, threshold, np.array([n[3] for n in nodes], np.int64), np.array(value), np.zeros(len(nodes), np.uint64))


def grow_tree(source, edges: np.ndarray, columns: np.ndarray, b: Boost, first: np.ndarray | None = None) -> Tree:
    """One tree.  ``source.histograms(nodes)`` gives nodes x 2 x columns x bins of the
    present nodes' rows, ``source.split([(node, column, bin, left)])`` parts them;
    ``first`` is the root's histogram, if there is one.  Leaf by leaf, a source that
    looks ``ahead`` is asked as :func:`grow_ahead` says."""
    if b.max_leaves and getattr(source, "ahead", False):
        return grow_ahead(source, edges, columns, b, source.histograms([0]) if first is None else first)
    feature, threshold, left, value, depth = [-1], [0.0], [0], [0.0], [0]
    waiting: list = []  # (order, node, column, bin, histogram)

    def enter(nodes: list[int], hist: np.ndarray) -> None:
        for node, h, (gain, f, cut) in zip(nodes, hist, best_splits(hist, b), strict=True):
            value[node] = b.rate * b.leaf(h[0, 0].sum(), h[1, 0].sum())
            if gain > max(b.gamma, LEAST_GAIN) and (b.max_depth is None or depth[node] < b.max_depth):
                heapq.heappush(waiting, (-gain if b.max_leaves else depth[node], node, f, cut, h))

    enter([0], source.histograms([0]) if first is None else first)
    leaves = 1
    while waiting and (b.max_leaves is None or leaves < b.max_leaves):
        at = [heapq.heappop(waiting)]
        while not b.max_leaves and waiting and waiting[0][0] == at[0][0]:
            at.append(heapq.heappop(waiting))
        done, small, large = [], [], []
        for _, node, f, cut, h in at:
            feature[node], threshold[node], left[node] = int(columns[f]), float(edges[columns[f], cut]), len(feature)
            done.append((node, int(columns[f]), cut, len(feature)))
            pair = (len(feature), len(feature) + 1)
            below = _below(h, f, cut)
            small.append(pair[not below])
            large.append(pair[below])
            for _ in range(2):
                feature.append(-1)
                threshold.append(0.0)
                left.append(0)
                value.append(0.0)
                depth.append(depth[node] + 1)
            leaves += 1
        source.split(done, len(feature))
        # children at the depth limit are leaves: their sums follow from the split
        inner = [i for i, pair in enumerate(done) if b.max_depth is None or depth[pair[3]] < b.max_depth]
        for i in set(range(len(at))) - set(inner):
            _, node, f, cut, h = at[i]
            here, total = h[:, f, :cut + 1].sum(1), h[:, f].sum(1)
            for child, (g, w) in ((left[node], here), (left[node] + 1, total - here)):
                value[child] = b.rate * b.leaf(g, w)
        if inner:
            got = source.histograms([small[i] for i in inner])
            rest = np.stack([at[i][4] for i in inner]) - got
            enter([small[i] for i in inner] + [large[i] for i in inner], np.concatenate([got, rest]))
    n = len(feature)
    return Tree(np.array(feature, np.int16), np.array(threshold), np.array(left, np.int64), np.array(value), np.zeros(n, np.uint64))


def _cells(codes: np.ndarray, columns: np.ndarray, bins: int) -> np.ndarray:
    return codes[:, columns].astype(np.int64) + np.arange(len(columns)) * bins


def _sums(cells: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray | None, slots: int, p: int, bins: int) -> np.ndarray:
    """slots x 2 x p x bins; rows of slot -1 don't count."""
    rows = np.flatnonzero(slot >= 0)
    at = (slot[rows, None] * (p * bins) + cells[rows]).ravel()
    size = slots * p * bins
    out = np.empty((slots, 2, p, bins))
    out[:, 0] = np.bincount(at, np.repeat(g[rows], p), size).reshape(slots, p, bins)
    weights = None if h is None else np.repeat(h[rows], p)
    out[:, 1] = np.bincount(at, weights, size).reshape(slots, p, bins)
    return out


class NumpyRows:
    """A source over arrays.  Rows with ``use`` false are routed but don't count."""

    def __init__(self, codes: np.ndarray, bins: int):
        self.codes, self.bins = codes, bins

    def begin(self, columns: np.ndarray, g: np.ndarray, h: np.ndarray | None, use: np.ndarray) -> None:
        self.at = np.zeros(len(self.codes), np.int64)
        self.columns, self.cells, self.g, self.h, self.use = columns, _cells(self.codes, columns, self.bins), g, h, use

    def histograms(self, nodes: list[int]) -> np.ndarray:
        place = np.full(max(int(self.at.max(initial=0)), *nodes) + 1, -1)
        place[nodes] = np.arange(len(nodes))
        slot = np.where(self.use, place[self.at], -1)
        return _sums(self.cells, slot, self.g, self.h, len(nodes), len(self.columns), self.bins)

    def split(self, splits: list[tuple[int, int, int, int]], nodes: int) -> None:
        table = np.full((3, nodes), -1)
        for node, f, cut, left in splits:
            table[:, node] = f, cut, left
        f, cut, left = table[:, self.at]
        rows = np.flatnonzero(f >= 0)
        self.at[rows] = left[rows] + (self.codes[rows, f[rows]] > cut[rows])


@dataclass
class BoostModel:
    base: float
    trees: list[Tree]
    curve: list[float]  # validation MSE after each tree, if there were validation rows
    features_col: str = "features"

    def first(self, k: int) -> BoostModel:
        return replace(self, trees=self.trees[:k], curve=self.curve[:k])

    @property
    def best_iteration(self) -> int:
        """Trees with the lowest validation error; ties to fewer."""
        return int(np.argmin(self.curve)) + 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.walk(x)[0][0]
        return out

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        held = df.sparkSession.sparkContext.broadcast(self)  # trees of bounded leaves

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            return pd.Series(held.value.predict(np.stack(x.to_numpy())))

        return df.withColumn(out, score(vector_to_array(F.col(self.features_col))))

    def dumps(self) -> bytes:
        import pickle
        return pickle.dumps((self.base, [t.dumps() for t in self.trees], self.curve))

    @staticmethod
    def loads(data: bytes, features_col: str = "features") -> BoostModel:
        import pickle
        base, trees, curve = pickle.loads(data)
        return BoostModel(base, [Tree.loads(t) for t in trees], curve, features_col)


def _stopped(curve: list[float], patience: int | None) -> bool:
    return bool(patience and curve) and len(curve) - 1 - int(np.argmin(curve)) >= patience


def fit_arrays(keys: np.ndarray, codes: np.ndarray, y: np.ndarray, valid: np.ndarray, edges: np.ndarray, b: Boost) -> BoostModel:
    """A whole fit in numpy; ``valid`` rows only count for the validation curve."""
    train = ~valid
    base = float(y[train].mean())
    prediction = np.full(len(y), base)
    source = NumpyRows(codes, edges.shape[1] + 1)
    trees, curve = [], []
    for t in range(b.n_trees):
        source.begin(b.columns(codes.shape[1], t), prediction - y, None, train & b.sampled(keys, t))
        tree = grow_tree(source, edges, source.columns, b)
        prediction += tree.value[source.at]
        trees.append(tree)
        if valid.any():
            curve.append(float(np.mean((prediction[valid] - y[valid]) ** 2)))
            if _stopped(curve, b.patience):
                break
    return BoostModel(base, trees, curve)


# ---------------------------------------------------------------- the cluster
def binned(df: DataFrame, features_col: str, label: str, key: str | None, part: str | None, bins: int) -> tuple[DataFrame, np.ndarray]:
    """Staged rows (key, codes, y, part) with a label, and the bins' upper edges."""
    x, y = vector_to_array(F.col(features_col)), F.col(label).cast("double")
    rows = df.select((F.xxhash64(F.col(key)) if key else F.xxhash64(x, y)).alias("key"), x.alias("x"), y.alias("y"),
                     (F.col(part).cast("int") if part else F.lit(-1)).alias("part")).where("y IS NOT NULL")
    rows = stage_table(rows, "boost-rows")
    p = rows.agg(F.max(F.size("x"))).first()[0]
    if not p:
        raise ValueError("no rows to boost on")
    edges = bin_edges(rows, p, min(bins, 256))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            codes = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(p)], axis=1).astype(np.uint8) if len(x) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(2), batch.column(3)],
                                             ["key", "codes", "y", "part"])

    return stage_table(rows.mapInArrow(code, "key long, codes binary, y double, part int"), "boost-codes"), edges


def _codes(column: pa.Array) -> np.ndarray:
    """Rows x columns of a binary column whose values have one length, without a copy."""
    n = len(column)
    if not n:
        return np.zeros((0, 0), np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + n + 1]
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]].reshape(n, -1)


def _route(codes: np.ndarray, tree: list[tuple[int, int, int, int]], nodes: int) -> np.ndarray:
    """Node of each row after the splits, a level of the tree at a time: a row
    that meets a leaf stays there."""
    at = np.zeros(len(codes), np.int32)
    if not tree:
        return at
    feature, cut, left = np.zeros(nodes, np.int32), np.full(nodes, 256, np.int32), np.arange(nodes, dtype=np.int32)
    depth = np.zeros(nodes, np.int64)
    for node, f, c, to in tree:  # a parent before its children
        feature[node], cut[node], left[node] = f, c, to
        depth[to:to + 2] = depth[node] + 1
    flat, start = codes.ravel(), np.arange(len(codes), dtype=np.int64) * codes.shape[1]
    for _ in range(int(depth.max())):
        # no code is above a leaf's cut, so its rows go to the leaf itself
        at = left[at] + (flat[start + feature[at]] > cut[at])
    return at


def present_codes(edges: np.ndarray) -> list[np.ndarray]:
    """The codes that each column can have: edges may be equal."""
    return [np.r_[np.unique(e, return_index=True)[1], len(e)] for e in edges]


def blocks(rows: DataFrame, edges: np.ndarray, with_part: bool = True, with_key: bool = True) -> RDD:
    """The staged rows as arrays (numbers among :func:`present_codes` by column, y,
    part or None, key or None) of about ``BLOCK_ROWS`` rows, kept by the executors in memory or on disk and dealt evenly to the cores:
    a pass of a tree is then a short job of one task a core."""
    p, dense = len(edges), np.zeros((len(edges), 256), np.uint8)
    for f, c in enumerate(present_codes(edges)):
        dense[f, c] = np.arange(len(c))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            codes, y, part, key = (pa.concat_arrays([b.column(i) for b in held]) for i in (1, 2, 3, 0))
            # a row without a part is no validation row
            columns = (np.stack([d[c] for d, c in zip(dense, _codes(codes).T, strict=True)]), y.to_numpy(),
                       part.fill_null(np.iinfo(np.int32).min).to_numpy() if with_part else None, key.to_numpy() if with_key else None)
            return pa.RecordBatch.from_arrays([pa.array([None if c is None else c.tobytes()], pa.binary()) for c in columns], ["codes", "y", "part", "key"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_ROWS:
                yield block()
                held = []
        if held:
            yield block()

    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * (1 + rows.count() * (p + 20) // (cores * PARTITION_BYTES))
    packed = rows.repartition(tasks).mapInArrow(pack, "codes binary, y binary, part binary, key binary")
    return packed.rdd.map(lambda r: (np.frombuffer(r[0], np.uint8).reshape(p, -1), np.frombuffer(r[1]),
                                     None if r[2] is None else np.frombuffer(r[2], np.int32),
                                     None if r[3] is None else np.frombuffer(r[3], np.int64))).persist(StorageLevel.MEMORY_AND_DISK)


def routed(codes: np.ndarray, tree: list[tuple[int, int, int, int]], nodes: int) -> np.ndarray:
    """:func:`_route` on codes by column."""
    at = np.zeros(codes.shape[1], np.intp)
    if not tree:
        return at
    feature, cut, left = np.zeros(nodes, np.intp), np.full(nodes, 256, np.int16), np.arange(nodes, dtype=np.intp)
    depth = np.zeros(nodes, np.int64)
    for node, f, c, to in tree:
        feature[node], cut[node], left[node] = f * codes.shape[1], c, to
        depth[to:to + 2] = depth[node] + 1
    flat, row = codes.ravel(), np.arange(codes.shape[1], dtype=np.intp)
    _, f, c, to = tree[0]
    at = to + (codes[f] > c)
    for _ in range(int(depth.max()) - 1):
        at = left[at] + (flat[feature[at] + row] > cut[at])
    return at


class Cells:
    """Histograms, slots x 2 x columns x bins, of rows added block by block.  Columns are
    counted together while their bins' product and the slots stay within ``JOINT_CELLS``."""

    def __init__(self, slots: int, columns: np.ndarray, present: list[np.ndarray], bins: int):
        self.slots, self.columns, self.present, self.bins = slots, columns, present, bins
        self.groups: list[list[int]] = []  # places in ``columns``
        size = 0
        for i, f in enumerate(columns):
            if self.groups and size * len(present[f]) * slots <= JOINT_CELLS:
                self.groups[-1].append(i)
                size *= len(present[f])
            else:
                self.groups.append([i])
                size = len(present[f])
        self.shapes = [(slots, *(len(present[columns[i]]) for i in g)) for g in self.groups]
        self.sums = [np.zeros((2, math.prod(s))) for s in self.shapes]

    def add(self, codes: np.ndarray, slot: np.ndarray, use: np.ndarray | None, g: np.ndarray, h: np.ndarray | None) -> None:
        """Rows ``use`` (None: all) with their slots, gradients and hessians (None: ones)."""
        for own, shape, sums in zip(self.groups, self.shapes, self.sums, strict=True):
            size = math.prod(shape[1:])
            cell = codes[self.columns[own[0]]].astype(np.min_scalar_type(size))
            for i, n in zip(own[1:], shape[2:], strict=True):
                cell *= cell.dtype.type(n)
                cell += codes[self.columns[i]]
            at = slot * size
            at += cell if use is None else cell[use]
            sums[0] += np.bincount(at, g, sums.shape[1])
            sums[1] += np.bincount(at, h, sums.shape[1])

    def histograms(self) -> np.ndarray:
        out = np.zeros((self.slots, 2, len(self.columns), self.bins))
        for own, shape, sums in zip(self.groups, self.shapes, self.sums, strict=True):
            for place, i in enumerate(own):
                others = tuple(1 + a for a in range(1, len(shape)) if a != place + 1)
                out[:, :, i, self.present[self.columns[i]]] = sums.reshape(2, *shape).sum(axis=others).swapaxes(0, 1)
        return out


def gathered(parts: RDD, nodes: int, shape: tuple[int, ...]) -> np.ndarray:
    """Sum of the tasks' arrays (nodes x ...) sent as (node, sums); beyond
    ``REDUCED_BYTES`` added up by a shuffle, the driver gets one of each node."""
    sent = parts.getNumPartitions() * nodes * math.prod(shape) * 8
    if sent > REDUCED_BYTES:
        parts = parts.reduceByKey(np.add, min(nodes, 1 + sent // REDUCED_BYTES))
    out = np.zeros((nodes, *shape))
    for node, sums in parts.collect():
        out[node] += sums
    return out


class Passes:
    """A source over blocks that begin with the columns' codes, for one tree at a time."""

    ahead = True

    def __init__(self, state: RDD, edges: np.ndarray):
        self.state, self.bins, self.present = state, edges.shape[1] + 1, present_codes(edges)
        self.older, self.saved = [], None

    def begin(self, columns: np.ndarray) -> None:
        self.columns, self.splits, self.nodes = columns, [], 1

    def dense(self, f: int, cut: int) -> int:
        return int(np.searchsorted(self.present[f], cut, side="right")) - 1

    def split(self, splits: list[tuple[int, int, int, int]], nodes: int) -> None:
        self.splits, self.nodes = self.splits + [(n, f, self.dense(f, c), to) for n, f, c, to in splits], nodes

    def histograms(self, nodes: list[int]) -> np.ndarray:
        return self.summed(self.splits, self.nodes, nodes)

    def summed(self, splits: list[tuple[int, int, int, int]], total: int, nodes: list[int]) -> np.ndarray:
        read, columns, present, bins, root = self.reader(not splits), self.columns, self.present, self.bins, not splits
        shape = (2, len(columns), bins)

        def task(state: Iterator[tuple]) -> Iterator[tuple]:
            cells, errors = Cells(len(nodes), columns, present, bins), np.zeros(2)
            place = np.full(total, -1, np.intp)
            place[nodes] = np.arange(len(nodes))
            for block in state:
                codes, gradients, out, wrong = read(block)
                errors += wrong
                slot = place[routed(codes, splits, total)]
                if out is not None:
                    slot[out] = -1
                use = np.flatnonzero(slot >= 0)
                if len(use) == len(slot):
                    use = None
                cells.add(codes, slot if use is None else slot[use], use, *gradients(use))
            for i, s in enumerate(cells.histograms()):
                if s[1].any():
                    yield i, s
            if root:  # beside the sums of the one node
                yield 1, np.broadcast_to(errors[:, None, None], shape)

        got = gathered(self.state.mapPartitions(task), len(nodes) + root, shape)
        if root:
            self.error = got[1, :, 0, 0]
        return got[:len(nodes)]

    def renew(self, step, save: bool) -> None:
        """Keep the blocks that ``step`` makes of the present ones."""
        self.older.append(self.state)
        self.state = self.state.map(step).persist(StorageLevel.MEMORY_AND_DISK)
        if save:  # ends the lineage, in the shared folder
            self.state.checkpoint()
            self.state.count()
            self.release(self.state.getCheckpointFile())
        elif len(self.older) > 1:
            # the state before is read once more, to make this one
            for was in self.older[:-1]:
                was.unpersist()
            self.older = self.older[-1:]

    def release(self, saved: str | None = None) -> None:
        """Let go of what the present state doesn't need; with no argument, of all."""
        for was in self.older + ([] if saved else [self.state]):
            if was.is_cached:
                was.unpersist()
        self.older, was, self.saved = [], self.saved, saved
        if was:
            drop_path(self.state.context, was)


class ClusterRows(Passes):
    """A source over :func:`blocks`: rows keep a running residual, that is walked on by
    the trees since it was last kept."""

    def __init__(self, kept: RDD, edges: np.ndarray, b: Boost, base: float, valid: int | None):
        def start(block: tuple) -> tuple:
            codes, y, part, key = block
            return codes, base - y, None if valid is None else part == valid, key if b.subsample < 1 else None

        super().__init__(kept.map(start), edges)
        self.b = b
        self.recent: list[tuple[list, int, np.ndarray]] = []  # splits, nodes and values of the trees since the state was kept
        self.tree = 0

    def reader(self, root: bool):
        b, recent, tree = self.b, self.recent, self.tree

        def read(block: tuple) -> tuple:
            codes, r, held, keys = block
            r = _walked(codes, r, recent)
            out, wrong = held, np.zeros(2)
            if root and held is not None:
                wrong = np.array([(r[held] ** 2).sum(), held.sum()])
            if keys is not None:
                out = ~b.sampled(keys, tree) if out is None else out | ~b.sampled(keys, tree)
            return codes, lambda use: (r if use is None else r[use], None), out, wrong

        return read

    def end(self, tree: Tree) -> None:
        self.recent = [*self.recent, (self.splits, self.nodes, tree.value)]
        self.tree += 1
        if self.tree % KEPT_TREES and self.tree % STAGE_TREES:
            return
        recent, self.recent = self.recent, []
        self.renew(lambda s: (s[0], _walked(s[0], s[1], recent), *s[2:]), self.tree % STAGE_TREES == 0)

    def last_error(self) -> np.ndarray:
        """Validation error (sum of squares, rows) after the last tree."""
        recent = self.recent

        def task(state: Iterator[tuple]) -> Iterator[np.ndarray]:
            for codes, r, held, _ in state:
                yield np.array([(_walked(codes, r, recent)[held] ** 2).sum(), held.sum()])

        return np.sum(self.state.mapPartitions(task).collect(), axis=0)


def _walked(codes: np.ndarray, r: np.ndarray, trees: list[tuple[list, int, np.ndarray]]) -> np.ndarray:
    for splits, nodes, values in trees:
        r = r + values[routed(codes, splits, nodes)]
    return r


def fit_cluster(kept: RDD, edges: np.ndarray, b: Boost, valid: int | None = None, last: bool = False) -> BoostModel:
    """A fit by histogram passes over the :func:`blocks`; rows whose part is ``valid``
    only count for the validation curve.  The ``last`` fit of the blocks lets go of
    them once its own state is kept."""
    def labels(block: tuple) -> np.ndarray:
        y = block[1] if valid is None else block[1][block[2] != valid]
        return np.array([y.sum(), len(y)])

    total, n = np.sum(kept.map(labels).collect(), axis=0)
    source = ClusterRows(kept, edges, b, float(total / n), valid)
    trees, curve = [], []
    try:
        for t in range(b.n_trees):
            columns = b.columns(len(edges), t)
            source.begin(columns)
            first = source.histograms([0])  # and the error of the trees so far
            if last and t == KEPT_TREES:
                kept.unpersist()
            if t and source.error[1]:
                curve.append(float(source.error[0] / source.error[1]))
                if _stopped(curve, b.patience):
                    break
            trees.append(grow_tree(source, edges, columns, b, first))
            source.end(trees[-1])
        else:
            if valid is not None and trees:
                error = source.last_error()
                curve += [float(error[0] / error[1])] if error[1] else []
    finally:
        source.release()
    return BoostModel(float(total / n), trees, curve)


def fit_side_by_side(rows: DataFrame, edges: np.ndarray, jobs: list[tuple[Boost, int | None]],
                     broadcast_bytes: int = BROADCAST_BYTES) -> list[BoostModel]:
    """The models of several (parameters, validation part), one task each if the
    table is within one broadcast, else one after the other over the cluster."""
    spark = rows.sparkSession
    if rows.count() * (len(edges) + 24) > broadcast_bytes:
        kept = blocks(rows, edges, any(v is not None for _, v in jobs), any(b.subsample < 1 for b, _ in jobs))
        try:
            return [fit_cluster(kept, edges, b, v, i == len(jobs) - 1) for i, (b, v) in enumerate(jobs)]
        finally:
            kept.unpersist()
    got = rows.toArrow().combine_chunks()
    keys, y = got["key"].to_numpy(), got["y"].to_numpy()
    order = np.lexsort((y, keys))
    held = spark.sparkContext.broadcast((keys[order], _codes(got["codes"].combine_chunks())[order], y[order], got["part"].to_numpy()[order]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, y, part = held.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                b, v = jobs[i]
                model = fit_arrays(keys, codes, y, np.zeros(len(y), bool) if v is None else part == v, edges, b)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([model.dumps()], pa.binary())], ["i", "model"])

    # long fits first, a task each
    ranked = sorted(range(len(jobs)), key=lambda i: -jobs[i][0].n_trees * (jobs[i][0].max_depth or 8))
    numbers = spark.createDataFrame([(i,) for i in ranked], "id long").repartition(len(jobs))
    rows_ = numbers.mapInArrow(task, "i long, model binary").collect()  # trees of bounded leaves
    return [BoostModel.loads(r["model"]) for r in sorted(rows_, key=lambda r: r["i"])]


def fit_boosted(df: DataFrame, b: Boost, features_col: str = "features", label: str = "label", key: str | None = None,
                valid_col: str | None = None, bins: int = BINS, broadcast_bytes: int = BROADCAST_BYTES) -> BoostModel:
    """Fit on the rows with a label; rows whose ``valid_col`` is 1 are validation rows."""
    rows, edges = binned(df, features_col, label, key, valid_col, bins)
    model = fit_side_by_side(rows, edges, [(b, 1 if valid_col else None)], broadcast_bytes)[0]
    return replace(model, features_col=features_col)


def cross_validate(df: DataFrame, candidates: list[Boost], fold_col: str, k: int, features_col: str = "features",
                   label: str = "label", key: str | None = None, bins: int = BINS, broadcast_bytes: int = BROADCAST_BYTES) -> list[float]:
    """Mean RMSE over the folds.  Candidates that differ in the number of trees only
    share one fit a fold."""
    rows, edges = binned(df, features_col, label, key, fold_col, bins)
    if rows.select("part").distinct().count() != k:
        raise ValueError("a fold without rows: no score to choose by")
    most: dict[Boost, int] = {}
    for c in candidates:
        same = replace(c, n_trees=0)
        most[same] = max(most.get(same, 0), c.n_trees)
    jobs = [(replace(same, n_trees=n), f) for same, n in most.items() for f in range(k)]
    curves = {(replace(b, n_trees=0), f): m.curve for (b, f), m in zip(jobs, fit_side_by_side(rows, edges, jobs, broadcast_bytes), strict=True)}

    def error(c: Boost, f: int) -> float:
        curve = curves[replace(c, n_trees=0), f]
        return math.sqrt(min(curve[:c.n_trees]) if c.patience else curve[c.n_trees - 1])

    return [float(np.mean([error(c, f) for f in range(k)])) for c in candidates]
