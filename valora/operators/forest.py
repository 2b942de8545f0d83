"""M7: random forests by two-phase tree growth.

Rows are staged once.  While a node holds more than ``node_rows`` rows it is
split on the cluster: every task adds its rows' weights and weighted labels to
histograms of the node (feature x bin), the histograms of a node are added up by
a shuffle on (tree, node), and only the chosen splits come back.  A node of at
most ``node_rows`` rows is handed, by a shuffle on (tree, node), to one task,
which finishes its subtree exactly (every distinct value is a candidate) in
numpy, all nodes of a level at a time.  A table that is itself that small, or
whose features' values are few enough to be held as ranks of a byte or two, is
broadcast instead (its bytes are checked) and each task grows whole trees.

Bootstrap weights are Poisson(1) draws from a hash of (row key, tree), feature
subsets from a hash of the node's path, so a tree depends neither on partitions
nor on the order of growth: its first ``d`` levels are the tree of depth ``d``,
and the first ``k`` trees the forest of ``k``.  A search fits the largest forest
of a group of candidates once and scores all of the group from it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_parallelism, owned_path, stage_table

#: A node of at most so many rows is finished by one task.
NODE_ROWS = 1 << 19
#: Bytes of a table, or of trees, that one broadcast may hold.
BROADCAST_BYTES = 64 << 20
#: Distinct values of a feature up to which its values may be held as ranks.
RANKED_VALUES = 1 << 16
#: Bytes of summed predictions that the tasks of a search send on, and held-out rows of one piece.
SUMS_BYTES, SUMS_ROWS = 256 << 20, 1 << 17
#: Histogram cells (8 bytes, three sums) that a task holds at a time.
HISTOGRAM_CELLS = 8 << 20
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function, element by element."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _salted(*salts: int) -> np.uint64:
    out = np.uint64(0x9E3779B97F4A7C15)
    for s in salts:
        out = mix64(np.uint64((int(out) + int(s) * 0x9E3779B97F4A7C15 + 1) % 2 ** 64))
    return np.uint64(out)


def bootstrap(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Poisson(1) weights of the rows in a tree."""
    u = (mix64(keys.astype(np.int64).view(np.uint64) ^ _salted(seed, tree)) >> np.uint64(11)) * (1.0 / (1 << 53))
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


@dataclass(frozen=True)
class Growth:
    """Limits of a tree.  ``max_features``: None, a count, or a share of the
    features that a node may choose from.  ``resample``: Poisson(1) weights, else
    every row counts once."""

    max_depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    max_features: float | int | None = None
    resample: bool = True

    def weights(self, keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
        return bootstrap(keys, tree, seed) if self.resample else np.ones(len(keys))

    def subset(self, p: int) -> int:
        m = self.max_features
        if m is None:
            return p
        return max(1, min(p, int(m * p) if isinstance(m, float) else int(m)))


@dataclass
class Tree:
    """Nodes in order of growth: ``feature`` -1 is a leaf, else rows up to
    ``threshold`` go to ``left``, the others to ``left + 1``.  A node that a task
    has still to finish has ``path``."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    path: np.ndarray

    def dumps(self) -> bytes:
        n = np.int64(len(self.feature)).tobytes()
        return b"".join([n, self.feature.astype(np.int16).tobytes(), self.left.astype(np.int32).tobytes(),
                         self.threshold.tobytes(), self.value.tobytes(), self.path.tobytes()])

    @staticmethod
    def loads(data: bytes) -> Tree:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        at, out = 8, []
        for kind in (np.int16, np.int32, np.float64, np.float64, np.uint64):
            out.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return Tree(out[0], out[2], out[1], out[3], out[4])

    def walk(self, x: np.ndarray, depths: list[int | None] = (None,)) -> tuple[list[np.ndarray], np.ndarray]:
        """Of each row of ``x`` the value at each depth (None: the leaf), and its leaf."""
        at = np.zeros(len(x), np.int64)
        values: dict = {}
        rows = np.arange(len(x))
        level = 0
        while True:
            if level in depths:
                values[level] = self.value[at]
            feature = self.feature[at[rows]]
            rows, feature = rows[feature >= 0], feature[feature >= 0]
            if not len(rows):
                break
            here = at[rows]
            at[rows] = self.left[here] + (x[rows, feature] > self.threshold[here])
            level += 1
        leaf = self.value[at]
        return [values.get(d, leaf) if d is not None else leaf for d in depths], at


def walk_ranks(tree: Tree, codes: np.ndarray, values: list[np.ndarray], depths: list[int | None]) -> np.ndarray:
    """:meth:`Tree.walk` on ranks (features x rows): depths x rows of the values."""
    n = codes.shape[1]
    if missing := [f for f, v in enumerate(values) if len(v) and v[-1] != v[-1]]:
        codes = codes.copy()
        for f in missing:  # as there, no missing value is above a threshold
            codes[f][codes[f] == len(values[f]) - 1] = 0
    cut = np.zeros(len(tree.feature), np.int32)  # the last rank that goes left
    for f, v in enumerate(values):
        own = np.flatnonzero(tree.feature == f)
        cut[own] = np.searchsorted(v, tree.threshold[own], side="right") - 1
    start, left, flat = tree.feature.astype(np.int64) * n, tree.left.astype(np.int64), codes.ravel()
    at, rows, level = np.zeros(n, np.int64), np.arange(n), 0
    out = np.empty((len(depths), n))
    node, own = at, start[at]
    while True:
        if level in depths:
            at[rows] = node
            out[depths.index(level)] = tree.value[at]
        inner = own >= 0
        if not inner.all():
            at[rows[~inner]] = node[~inner]
            rows, node, own = rows[inner], node[inner], own[inner]
        if not len(rows):
            break
        node = left[node] + (flat[own + rows] > cut[node])
        own = start[node]
        level += 1
    for i, d in enumerate(depths):
        if d is None or d > level:
            out[i] = tree.value[at]
    return out


def allowed(paths: np.ndarray, p: int, m: int) -> np.ndarray | None:
    """Nodes x features: the ``m`` features that each node may choose from."""
    if m >= p:
        return None
    with np.errstate(over="ignore"):
        rank = mix64(paths[:, None] + np.arange(1, p + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros((len(paths), p), bool)
    np.put_along_axis(out, np.argpartition(rank, m - 1, axis=1)[:, :m], True, axis=1)
    return out


def child_paths(paths: np.ndarray) -> np.ndarray:
    """Paths of both children of each node, in turn."""
    with np.errstate(over="ignore"):
        return mix64(np.repeat(paths, 2) * np.uint64(2) + np.tile(np.array([1, 2], np.uint64), len(paths)))


def ranked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Features x rows of each value's rank among the distinct values of its
    feature, and those values in order (a missing one last)."""
    values, codes = [], []
    for column in x.T:
        v, c = np.unique(column, return_inverse=True)
        values.append(v)
        codes.append(c)
    kind = np.min_scalar_type(max((len(v) for v in values), default=0))
    return np.array(codes, kind).reshape(x.shape[1], len(x)), values


def unranked(codes: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Rows x features of the values again."""
    return np.stack([v[c] for v, c in zip(values, codes, strict=True)], axis=1)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, limits: Growth, path: int, depth: int = 0) -> Tree:
    """Finish a subtree exactly.  ``x`` rows x features, ``w`` positive weights.
    Splits halve the distance between neighbouring values and have the largest
    decrease of the weighted squared error; ties go to the lower feature, then the
    lower value.  A node of one label, or with no admissible split, is a leaf."""
    return grow_ranked(*ranked(x), y, w, limits, path, depth)


def _present(cell: np.ndarray, cells: int, sums: list[np.ndarray | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The cells that have rows, in order, and the rows' sums there (None: their
    number): by counting while the cells are not many more than the rows, else by
    sorting.  The first of ``sums`` has positive numbers only."""
    if cells <= 8 * len(cell):
        dense = [np.bincount(cell, s, cells) for s in sums]
        have = np.flatnonzero(dense[0] != 0)
        return have, [s[have] for s in dense]
    if cells * len(cell) < 1 << 62:  # one sort of numbers: the cell above, the row below
        bits = np.int64(len(cell).bit_length())
        cell = np.sort((cell << bits) | np.arange(len(cell)))
        order = cell & ((np.int64(1) << bits) - 1)
        cell >>= bits
    else:
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    return cell[first], [np.diff(np.r_[first, len(cell)]) if s is None else np.add.reduceat(s[order], first) for s in sums]


def _kept(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those rows of every feature."""
    out = np.empty((len(codes), len(rows)), codes.dtype)
    for f, column in enumerate(codes):
        np.take(column, rows, out=out[f], mode="clip")
    return out


def grow_ranked(codes: np.ndarray, values: list[np.ndarray], y: np.ndarray, w: np.ndarray, limits: Growth, path: int,
                depth: int = 0) -> Tree:
    """:func:`grow` on ranks: a level's candidates are read off the rows' sums by
    (node, rank), the rows of a node lying together."""
    p, n = codes.shape
    centre = float(np.average(y, weights=w)) if n else 0.0
    wy = w * (y - centre)
    starts = np.array([0, n])
    subset = limits.subset(p)
    paths = np.array([path], np.uint64)
    finite = [int(np.count_nonzero(v == v)) for v in values]
    feature, threshold, left, value = [], [], [], []
    made = 1
    while True:
        k = len(starts) - 1
        sizes = np.diff(starts)
        weight, total = np.add.reduceat(w, starts[:-1]), np.add.reduceat(wy, starts[:-1])
        low, high = np.minimum.reduceat(y, starts[:-1]), np.maximum.reduceat(y, starts[:-1])
        value.append(centre + total / weight)
        open_ = (low < high) & (sizes >= max(limits.min_split, 2 * limits.min_leaf))
        if limits.max_depth is not None and depth >= limits.max_depth:
            open_[:] = False
        best_f = np.full(k, -1)
        best_c, best_t = np.zeros(k, np.int64), np.zeros(k)
        if not open_.all():  # rows of leaves are done with
            stay = np.flatnonzero(np.repeat(open_, sizes))
            codes, y, w, wy = _kept(codes, stay), y[stay], w[stay], wy[stay]
        nodes = np.flatnonzero(open_)
        m = len(nodes)
        seg = np.repeat(np.arange(m), sizes[nodes])
        if m:
            may = allowed(paths[nodes], p, subset)
            all_w, all_y, rows = weight[nodes], total[nodes], sizes[nodes]
            sums = [w, wy] if limits.min_leaf <= 1 else [w, wy, None]
            top_so_far = np.full(m, -np.inf)
            for f in range(p):
                d = len(values[f])
                if d < 2 or may is not None and not may[:, f].any():
                    continue
                cell = seg * d
                cell += codes[f]
                have, got = _present(cell, m * d, sums)
                s = have // d
                ends = np.flatnonzero(s[1:] != s[:-1])  # every open node has rows
                first = np.r_[0, ends + 1]
                count = np.diff(np.r_[first, len(s)])
                if len(s) == m:
                    continue  # one value a node
                cw, cy = np.cumsum(got[0]), np.cumsum(got[1])
                wl = cw - np.repeat(np.r_[0.0, cw[ends]], count)
                yl = cy - np.repeat(np.r_[0.0, cy[ends]], count)
                wr, yr = np.repeat(all_w, count) - wl, np.repeat(all_y, count) - yl
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = yl * yl / wl + yr * yr / wr
                # a candidate lies between two values of a node, the upper one not missing
                gain[ends] = gain[-1] = -np.inf
                if finite[f] < d:
                    gain[:-1][have[1:] - s[1:] * d >= finite[f]] = -np.inf
                if may is not None:
                    gain[~np.repeat(may[:, f], count)] = -np.inf
                if limits.min_leaf > 1:
                    cn = np.cumsum(got[2])
                    upto = cn - np.repeat(np.r_[0, cn[ends]], count)
                    gain[(upto < limits.min_leaf) | (np.repeat(rows, count) - upto < limits.min_leaf)] = -np.inf
                top = np.maximum.reduceat(gain, first)
                with np.errstate(invalid="ignore"):
                    better = top > top_so_far + 1e-12 * np.abs(top)
                if better.any():
                    # first place of each such node's largest gain
                    hit = np.flatnonzero(gain == np.repeat(np.where(better, top, np.nan), count))
                    i = hit[np.r_[True, s[hit][1:] != s[hit][:-1]]]
                    c, upper = have[i] - s[i] * d, values[f][have[i + 1] - s[i] * d]
                    lower, chosen = values[f][c], nodes[better]
                    top_so_far[better], best_f[chosen], best_c[chosen] = top[better], f, c
                    with np.errstate(invalid="ignore"):
                        half = lower + (upper - lower) / 2
                    best_t[chosen] = np.where(half < upper, half, lower)
        split = best_f >= 0
        feature.append(best_f)
        threshold.append(best_t)
        lefts = np.zeros(k, np.int64)
        lefts[split] = made + 2 * np.arange(split.sum())
        left.append(lefts)
        if not split.any():
            break
        made += 2 * int(split.sum())
        # rows of split nodes, parted in place order: left before right
        parted = split[nodes]
        target = (np.cumsum(parted) - 1)[seg]
        if not parted.all():
            stay = np.flatnonzero(parted[seg])
            codes, y, w, wy, target = _kept(codes, stay), y[stay], w[stay], wy[stay], target[stay]
        here = np.arange(len(y))
        cut_on, cut_at = best_f[split], best_c[split].astype(codes.dtype)
        right = codes.ravel()[cut_on[target] * len(y) + here] > cut_at[target]
        child = 2 * target + right
        counts = np.bincount(child, minlength=2 * int(split.sum()))
        starts = np.concatenate([[0], np.cumsum(counts)])
        so_far = np.cumsum(right)  # rows to the right so far, this one included, of all nodes and then of its own
        so_far -= np.concatenate([[0], np.cumsum(counts[1::2])])[target]
        put = np.empty(len(y), np.int64)
        put[np.where(right, starts[child] + so_far - 1, here - so_far)] = here
        codes, y, w, wy = _kept(codes, put), y[put], w[put], wy[put]
        paths = child_paths(paths[split])
        depth += 1
    feature, threshold, left, value = (np.concatenate(v) for v in (feature, threshold, left, value))
    return Tree(feature, threshold, left, value, np.zeros(len(feature), np.uint64))


# ---------------------------------------------------------------- the cluster
def _rows(df: DataFrame, features_col: str, label: str, key: str | None, *more) -> DataFrame:
    """(key, x, y) and ``more`` of the rows with a label; without a key column a
    row's key is the hash of its values."""
    x, y = vector_to_array(F.col(features_col)), F.col(label).cast("double")
    k = F.xxhash64(F.col(key)) if key else F.xxhash64(x, y)
    return df.select(k.alias("key"), x.alias("x"), y.alias("y"), *more).where("y IS NOT NULL")


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[list[pa.Array]]:
    """The columns of the batches, some ``rows`` rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
            held = []
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns


def bin_edges(rows: DataFrame, p: int, bins: int) -> np.ndarray:
    """features x (bins - 1) upper edges: approximate quantiles in one scan, used
    for the splits of large nodes only."""
    probs = [i / bins for i in range(1, bins)]
    cols = [F.percentile_approx(F.col("x")[f], probs, 50 * bins).alias(f"q{f}") for f in range(p)]
    got = rows.agg(*cols).first()
    return np.array([got[f] for f in range(p)], np.float64)


def distinct_values(rows: DataFrame, p: int, most: int = RANKED_VALUES) -> list[np.ndarray] | None:
    """Each feature's values in order (a missing one last); None if one has more than ``most``."""
    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[np.ndarray] = [np.zeros(0)] * p
        for column in _gathered(batches):
            x = _matrix(column[0])
            have = [np.unique(np.concatenate([v, np.unique(x[:, f])])) for f, v in enumerate(have)]
            if max(len(v) for v in have) > most:
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([0.0])], ["f", "v"])
                return
        for f, v in enumerate(have):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), f, np.int32)), pa.array(v)], ["f", "v"])

    found = rows.select("x").mapInArrow(values, "f int, v double").distinct()
    got = found.limit(p * most + 1).toArrow().combine_chunks()
    f, v = got["f"].to_numpy(), got["v"].to_numpy()
    out = [np.sort(v[f == i]) for i in range(p)]
    return None if (f < 0).any() or max(len(x) for x in out) > most else out


def _compact(rows: DataFrame, n: int, p: int, most_bytes: int) -> tuple[list[np.ndarray], pa.Table] | None:
    """The features' values, and the rows with ``x`` as the bytes of their ranks, in
    key order; None if they take more than ``most_bytes``."""
    if n * (p + 16) > most_bytes:
        return None
    values = distinct_values(rows, p)
    if values is None:
        return None
    kind = np.min_scalar_type(max(len(v) for v in values))
    if n * (p * kind.itemsize + 16) > most_bytes:
        return None
    at, names = rows.columns.index("x"), rows.columns

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(at))
            codes = np.stack([np.searchsorted(values[f], x[:, f]) for f in range(p)], axis=1).astype(kind) if len(x) else x
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array([c.tobytes() for c in codes], pa.binary()), *batch.columns[at + 1:]], names)

    schema = ", ".join(f"{f.name} {'binary' if f.name == 'x' else f.dataType.simpleString()}" for f in rows.schema.fields)
    got = rows.mapInArrow(code, schema).toArrow()
    return values, got.take(pa.array(np.lexsort((got["y"].to_numpy(), got["key"].to_numpy())))).combine_chunks()


def _codes(column: pa.Array, p: int, values: list[np.ndarray]) -> np.ndarray:
    """Features x rows of the ranks in a column of :func:`_compact`."""
    kind = np.min_scalar_type(max(len(v) for v in values))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.ascontiguousarray(np.frombuffer(data, np.uint8)[at[0]:at[-1]].view(kind).reshape(-1, p).T)


def _held(rows: DataFrame, n: int, p: int, node_rows: int, broadcast_bytes: int) -> tuple | None:
    """(keys, ranks, values, y, other columns) of a table that one task may hold, in key
    order, else None."""
    more = [c for c in rows.columns if c not in ("key", "x", "y")]
    if n <= node_rows and n * (p + 2 + len(more)) * 8 <= broadcast_bytes:
        got = rows.toArrow().combine_chunks()
        got = got.take(pa.array(np.lexsort((got["y"].to_numpy(), got["key"].to_numpy()))))
        codes, values = ranked(_matrix(got["x"].combine_chunks()))
    else:
        found = _compact(rows, n, p, broadcast_bytes * 3 // 2)
        if found is None:
            return None
        values, got = found
        codes = _codes(got["x"].combine_chunks(), p, values)
    return (got["key"].to_numpy(), codes, values, got["y"].to_numpy(), *(got[c].to_numpy() for c in more))


def _histograms(batches: Iterator[pa.RecordBatch], trees: dict[int, Tree], active: list[tuple[int, int]],
                edges: np.ndarray, limits: Growth, seed: int) -> Iterator[pa.RecordBatch]:
    """A task's sums of each active node: features x bins of rows, weight, weighted
    label."""
    p, width = edges.shape[0], edges.shape[1] + 1
    slots: dict[int, list[int]] = {}
    for slot, (t, _) in enumerate(active):
        slots.setdefault(t, []).append(slot)
    sums = np.zeros((3, len(active), p, width))
    for column in _gathered(batches):
        keys, x, y = column[0].to_numpy(), _matrix(column[1]), column[2].to_numpy()
        code = [np.searchsorted(edges[f], x[:, f], side="left") for f in range(p)]
        for t, own in slots.items():
            w = limits.weights(keys, t, seed)
            keep = np.flatnonzero(w > 0)
            place = np.full(len(trees[t].feature), -1)
            place[[active[i][1] for i in own]] = np.arange(len(own))
            if len(place) > 1:
                at = place[trees[t].walk(x[keep])[1]]
                keep, at = keep[at >= 0], at[at >= 0]
            else:
                at = np.zeros(len(keep), np.int64)
            wt, wy = w[keep], w[keep] * y[keep]
            at *= width
            for f in range(p):  # the cells of this tree's nodes only
                cell = at + code[f][keep]
                for i, v in enumerate((None, wt, wy)):
                    sums[i, own, f] += np.bincount(cell, v, len(own) * width).reshape(len(own), width)
    for slot, (t, node) in enumerate(active):
        if sums[0, slot].any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([t], pa.int32()), pa.array([node], pa.int64()), pa.array([sums[:, slot].tobytes()], pa.binary())],
                ["tree", "node", "sums"])


def _best_splits(batches: Iterator[pa.RecordBatch], edges: np.ndarray, limits: Growth,
                 paths: dict[tuple[int, int], int]) -> Iterator[pa.RecordBatch]:
    """Add up each node's sums and choose its split."""
    p, width = edges.shape[0], edges.shape[1] + 1
    have: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for t, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(data).reshape(3, p, width)
            have[t, node] = have[t, node] + part if (t, node) in have else part
    for (t, node), s in have.items():
        n, w, wy = np.cumsum(s, axis=2)[:, :, :-1]
        rows, weight, total = s[0, 0].sum(), s[1, 0].sum(), s[2, 0].sum()
        # an edge that doesn't part distinct values again has no rows of its own
        ok = (n >= limits.min_leaf) & (rows - n >= limits.min_leaf) & (np.diff(n, axis=1, prepend=0) > 0)
        may = allowed(np.array([paths[t, node]], np.uint64), p, limits.subset(p))
        if may is not None:
            ok &= may[0][:, None]
        mean = total / weight
        gain = np.full(n.shape, -np.inf)
        left = wy - mean * w
        gain[ok] = left[ok] ** 2 * (1 / w[ok] + 1 / (weight - w[ok]))
        f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
        good = np.isfinite(gain[f, b])
        yield pa.RecordBatch.from_arrays(
            [pa.array([t], pa.int32()), pa.array([node], pa.int64()), pa.array([int(f) if good else -1], pa.int32()),
             pa.array([float(edges[f, b])]), pa.array([float(mean)]), pa.array([float(n[f, b])]), pa.array([float(rows)])],
            ["tree", "node", "feature", "threshold", "value", "left_rows", "rows"])


def _top_levels(rows: DataFrame, count: int, p: int, numbers: list[int], limits: Growth, seed: int, node_rows: int,
                bins: int) -> dict[int, Tree]:
    """Trees whose leaves hold at most ``node_rows`` rows, or can't be split."""
    spark = rows.sparkSession
    nodes = {t: {"feature": [-1], "threshold": [0.0], "left": [0], "value": [0.0], "path": [int(_salted(seed, t))], "depth": [0]} for t in numbers}

    def tree(t: int) -> Tree:
        v = nodes[t]
        return Tree(np.array(v["feature"], np.int16), np.array(v["threshold"], np.float64), np.array(v["left"], np.int64),
                    np.array(v["value"], np.float64), np.array(v["path"], np.uint64))

    todo = [(t, 0) for t in numbers] if count > node_rows else []
    edges = bin_edges(rows, p, bins) if todo else None
    at_once = max(1, HISTOGRAM_CELLS // (3 * p * bins))
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while todo:
        new: list[tuple[int, int]] = []
        for i in range(0, len(todo), at_once):
            active = todo[i:i + at_once]
            partial = {t: tree(t) for t in {t for t, _ in active}}
            paths = {(t, n): nodes[t]["path"][n] for t, n in active}
            sums = rows.mapInArrow(lambda it, a=active, s=partial: _histograms(it, s, a, edges, limits, seed), "tree int, node long, sums binary")
            got = (sums.repartition(shuffles, "tree", "node")
                   .mapInArrow(lambda it, s=paths: _best_splits(it, edges, limits, s),
                               "tree int, node long, feature int, threshold double, value double, left_rows double, rows double")
                   .orderBy("tree", "node").collect())  # one row a node
            for r in got:
                v = nodes[r["tree"]]
                n = r["node"]
                v["value"][n] = r["value"]
                if r["feature"] < 0 or r["rows"] < limits.min_split or (limits.max_depth is not None and v["depth"][n] >= limits.max_depth):
                    v["path"][n] = 0
                    continue
                v["feature"][n], v["threshold"][n], v["left"][n] = r["feature"], r["threshold"], len(v["feature"])
                for path, size in zip(child_paths(np.array([v["path"][n]], np.uint64)), (r["left_rows"], r["rows"] - r["left_rows"]), strict=True):
                    for name, x in (("feature", -1), ("threshold", 0.0), ("left", 0), ("value", r["value"]), ("path", int(path)), ("depth", v["depth"][n] + 1)):
                        v[name].append(x)
                    if size > node_rows:
                        new.append((r["tree"], len(v["feature"]) - 1))
                v["path"][n] = 0
        todo = new
    return {t: tree(t) for t in numbers}


def _handed(batches: Iterator[pa.RecordBatch], tops: dict[int, Tree], limits: Growth, seed: int) -> Iterator[pa.RecordBatch]:
    """Rows of unfinished nodes, packed: (tree, node, key, weight and label and values)."""
    for column in _gathered(batches):
        keys, x, y = column[0].to_numpy(), _matrix(column[1]), column[2].to_numpy()
        for t, top in tops.items():
            w = limits.weights(keys, t, seed)
            rows = np.flatnonzero(w > 0)
            at = top.walk(x[rows])[1]
            rows, at = rows[top.path[at] > 0], at[top.path[at] > 0]
            order = np.argsort(at.astype(np.min_scalar_type(len(top.path))), kind="stable")
            rows, at = rows[order], at[order]
            cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1], True]) if len(at) else []
            packed = [np.column_stack([w[o], y[o], x[o]]).tobytes() + keys[o].tobytes()
                      for o in (rows[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True))] if len(at) else []
            if packed:
                at_node = [int(at[i]) for i in cuts[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([t] * len(packed), pa.int32()), pa.array(at_node, pa.int64()), pa.array(packed, pa.binary())],
                    ["tree", "node", "rows"])


def _finish(batches: Iterator[pa.RecordBatch], p: int, limits: Growth, tops: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
    """Packed rows, sorted by (tree, node), to finished subtrees."""
    held: tuple[int, int] | None = None
    parts: list[bytes] = []

    def out() -> pa.RecordBatch:
        blocks, keys = [], []
        for data in parts:
            n = len(data) // (8 * (p + 3))
            blocks.append(np.frombuffer(data, np.float64, n * (p + 2)).reshape(n, p + 2))
            keys.append(np.frombuffer(data, np.int64, n, n * (p + 2) * 8))
        m = np.concatenate(blocks)[np.argsort(np.concatenate(keys), kind="stable")]
        t, node = held
        depth = len(_ancestors(tops[t], node))
        done = grow(m[:, 2:], m[:, 1], m[:, 0], limits, int(tops[t].path[node]), depth)
        return pa.RecordBatch.from_arrays(
            [pa.array([t], pa.int32()), pa.array([node], pa.int64()), pa.array([done.dumps()], pa.binary())], ["tree", "node", "nodes"])

    for batch in batches:
        for t, node, data in zip(*batch.columns, strict=True):
            here = (t.as_py(), node.as_py())
            if here != held:
                if parts:
                    yield out()
                held, parts = here, []
            parts.append(data.as_py())
    if parts:
        yield out()


def spliced(top: Tree, subtrees: dict[int, Tree]) -> Tree:
    """``top`` with the subtrees in place of its unfinished nodes."""
    cols = {n: [getattr(top, n).copy()] for n in ("feature", "threshold", "left", "value", "path")}
    made = len(top.feature)
    for node, sub in subtrees.items():
        # the subtree's root takes the node's place, the others follow at the end
        shift = made - 1
        cols["feature"][0][node], cols["threshold"][0][node] = sub.feature[0], sub.threshold[0]
        cols["value"][0][node], cols["path"][0][node] = sub.value[0], 0
        cols["left"][0][node] = sub.left[0] + shift if sub.feature[0] >= 0 else 0
        for n in cols:
            more = getattr(sub, n)[1:]
            cols[n].append(np.where(sub.feature[1:] >= 0, more + shift, 0) if n == "left" else more)
        made += len(sub.feature) - 1
    return Tree(*(np.concatenate(cols[n]) for n in ("feature", "threshold", "left", "value", "path")))


def _summed(held):
    @F.pandas_udf("double")
    def add(x: pd.Series) -> pd.Series:
        rows = np.stack(x.to_numpy())
        return pd.Series(sum(t.walk(rows)[0][0] for t in held.value))
    return add


def _ancestors(tree: Tree, node: int) -> list[int]:
    """The nodes from the root to the parent of ``node``."""
    up: list[int] = []
    while node:
        node = int(np.flatnonzero((tree.feature >= 0) & ((tree.left == node) | (tree.left + 1 == node)))[0])
        up.append(node)
    return up[::-1]


def _routed(batches: Iterator[pa.RecordBatch], tops: dict[int, Tree]) -> Iterator[pa.RecordBatch]:
    """Rows (id, x) dealt to the leaves of every top, packed: (tree, node, kind 1, ids
    and values)."""
    for column in _gathered(batches):
        ids, x = column[0].to_numpy(), _matrix(column[1])
        for t, top in tops.items():
            at = top.walk(x)[1]
            order = np.argsort(at.astype(np.min_scalar_type(len(top.path))), kind="stable")
            cuts = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1], True])
            parts = [order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(parts), pa.int32()), pa.array([int(at[o[0]]) for o in parts], pa.int64()),
                 pa.array([1] * len(parts), pa.int32()), pa.array([ids[o].tobytes() + x[o].tobytes() for o in parts], pa.binary())],
                ["tree", "node", "kind", "data"])


def _valued(batches: Iterator[pa.RecordBatch], p: int, tops: dict[int, Tree], depths: list[int | None]) -> Iterator[pa.RecordBatch]:
    """Subtrees (kind 0) and after each the rows dealt to it: a row's value in the
    tree at each depth."""
    sub, d0, above = None, 0, []
    for batch in batches:
        for t, node, kind, data in zip(*batch.columns, strict=True):
            if not kind.as_py():
                sub, up = Tree.loads(data.as_py()), _ancestors(tops[t.as_py()], node.as_py())
                d0, above = len(up), tops[t.as_py()].value[up]
                continue
            raw = data.as_py()
            n = len(raw) // (8 * (p + 1))
            below = [d if d is None else max(d - d0, 0) for d in depths]
            got = dict(zip(below, sub.walk(np.frombuffer(raw, np.float64, n * p, n * 8).reshape(n, p), below)[0], strict=True))
            values = [np.full(n, above[d]) if d is not None and d < d0 else got[b] for d, b in zip(depths, below, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(raw, np.int64, n)), pa.array(np.full(n, t.as_py(), np.int32)), *(pa.array(v) for v in values)],
                ["id", "tree", *(f"v{i}" for i in range(len(depths)))])


@dataclass
class ForestModel:
    """Trees as a table (tree, nodes) in the shared folder, in order of their number;
    or, grown on the cluster, as ``tops`` and a table ``pieces`` (tree, node, nodes)
    of the subtrees below them."""

    path: str | None
    n_trees: int
    features_col: str
    spark: object
    tops: dict[int, Tree] | None = None
    pieces: DataFrame | None = None

    def groups(self, n_trees: int | None = None) -> Iterator[list[Tree]]:
        """The trees, as many at a time as one broadcast may hold."""
        if self.path is None:
            self.path = _splice(self.spark, self.tops, self.pieces)
        table = self.spark.read.parquet(self.path)
        sizes = table.where(F.col("tree") < (n_trees or self.n_trees)).select("tree", F.length("nodes").alias("n")).orderBy("tree").collect()
        at = 0
        while at < len(sizes):
            end, held = at, 0
            while end < len(sizes) and (end == at or held + sizes[end]["n"] <= BROADCAST_BYTES):
                held += sizes[end]["n"]
                end += 1
            rows = table.where(F.col("tree").between(sizes[at]["tree"], sizes[end - 1]["tree"])).orderBy("tree").collect()
            yield [Tree.loads(r["nodes"]) for r in rows]
            at = end

    def sums(self, rows: DataFrame, counts: list[int], depths: list[int | None] = [None]) -> DataFrame:
        """Of rows (id, x), the summed values of the first so many trees at each
        depth, as (id, s0, s1, ...) in order of ``counts`` and ``depths``.  The
        rows go to the subtrees, by a shuffle on (tree, node): a task holds one
        subtree, and nothing of the forest but its tops passes the driver."""
        tops = {t: v for t, v in self.tops.items() if t < max(counts)}
        p = rows.agg(F.max(F.size("x"))).first()[0] or 1
        shuffles = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        leaves = [(t, int(i), Tree(v.feature[i:i + 1], v.threshold[i:i + 1], v.left[i:i + 1], v.value[i:i + 1], v.path[i:i + 1]).dumps())
                  for t, v in tops.items() for i in np.flatnonzero((v.feature < 0) & (v.path == 0))]
        subs = self.pieces.where(F.col("tree") < max(counts)).unionByName(
            self.spark.createDataFrame(leaves, "tree int, node long, nodes binary"))
        dealt = rows.select("id", "x").mapInArrow(lambda it: _routed(it, tops), "tree int, node long, kind int, data binary")
        names = [f"v{i}" for i in range(len(depths))]
        values = (subs.select("tree", "node", F.lit(0).alias("kind"), F.col("nodes").alias("data")).unionByName(dealt)
                  .repartition(shuffles, "tree", "node").sortWithinPartitions("tree", "node", "kind")
                  .mapInArrow(lambda it: _valued(it, p, tops, depths), "id long, tree int, " + ", ".join(f"{n} double" for n in names)))
        return values.groupBy("id").agg(*[F.sum(F.when(F.col("tree") < c, F.col(n))).alias(f"s{i * len(names) + j}")
                                          for i, c in enumerate(counts) for j, n in enumerate(names)])

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """Mean of the trees' leaves; a group of trees is one broadcast, and trees
        grown on the cluster meet the rows there."""
        if self.tops is not None:
            held = stage_table(df.withColumn("__row", F.monotonically_increasing_id()), "forest-scored")
            rows = held.select(F.col("__row").alias("id"), vector_to_array(F.col(self.features_col)).alias("x"))
            total = self.sums(rows, [self.n_trees]).select(F.col("id").alias("__row"), (F.col("s0") / self.n_trees).alias(out))
            return held.drop(out).join(total, "__row").select(*[c for c in df.columns if c != out], out)
        total = F.lit(0.0)
        for trees in self.groups():
            total = total + _summed(self.spark.sparkContext.broadcast(trees))(vector_to_array(F.col(self.features_col)))
        return df.withColumn(out, total / self.n_trees)


def fit_forest(df: DataFrame, features_col: str = "features", label: str = "label", key: str | None = None,
               n_trees: int = 100, limits: Growth = Growth(), seed: int = 42, node_rows: int = NODE_ROWS,
               bins: int = 256, broadcast_bytes: int = BROADCAST_BYTES) -> ForestModel:
    """Fit on the rows of ``df`` whose label isn't null.  A missing feature value
    (NaN) goes right at every split and is never a candidate."""
    rows = stage_table(_rows(df, features_col, label, key), "forest-rows")
    return _fit_rows(rows, features_col, n_trees, limits, seed, node_rows, bins, broadcast_bytes)


def _fit_rows(rows: DataFrame, features_col: str, n_trees: int, limits: Growth, seed: int, node_rows: int, bins: int,
              broadcast_bytes: int) -> ForestModel:
    spark = rows.sparkSession
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p")).first()
    n, p = facts["n"], facts["p"]
    if not n:
        raise ValueError("no rows to fit a forest on")
    table = _held(rows, n, p, node_rows, broadcast_bytes)
    if table is not None:
        held = spark.sparkContext.broadcast(table)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for t in batch.column(0).to_pylist():
                    tree = _whole_tree(*held.value, t, limits, seed)
                    yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([tree.dumps()], pa.binary())], ["tree", "nodes"])

        numbers = spark.range(0, n_trees, 1, min(n_trees, 4 * spark.sparkContext.defaultParallelism))
        path = owned_path(spark, "forest")
        numbers.mapInArrow(whole, "tree int, nodes binary").write.parquet(path)
        return ForestModel(path, n_trees, features_col, spark)
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = ensure_parallelism(rows)
    tops = _top_levels(spread, n, p, list(range(n_trees)), limits, seed, node_rows, bins)
    done = (spread.mapInArrow(lambda it: _handed(it, tops, limits, seed), "tree int, node long, rows binary")
            .repartition(shuffles, "tree", "node").sortWithinPartitions("tree", "node")
            .mapInArrow(lambda it: _finish(it, p, limits, tops), "tree int, node long, nodes binary"))
    return ForestModel(None, n_trees, features_col, spark, tops, stage_table(done, "subtrees"))


def _splice(spark, tops: dict[int, Tree], stored: DataFrame) -> str:
    """The folder of the whole trees (tree, nodes)."""
    path = owned_path(spark, "forest")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one tree at a time: a task splices the subtrees of its trees
    tree_rows = (stored.unionByName(spark.createDataFrame([(t, -1, v.dumps()) for t, v in tops.items()], "tree int, node long, nodes binary"))
                 .repartition(shuffles, "tree").sortWithinPartitions("tree", "node"))

    def splice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, top, subs = None, None, {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([at], pa.int32()), pa.array([spliced(top, subs).dumps()], pa.binary())], ["tree", "nodes"])

        for batch in batches:
            for t, node, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if t != at:
                    if at is not None:
                        yield out()
                    at, subs = t, {}
                if node < 0:
                    top = Tree.loads(data)
                else:
                    subs[node] = Tree.loads(data)
        if at is not None:
            yield out()

    tree_rows.mapInArrow(splice, "tree int, nodes binary").write.parquet(path)
    return path


def _whole_tree(keys: np.ndarray, codes: np.ndarray, values: list[np.ndarray], y: np.ndarray, t: int, limits: Growth, seed: int) -> Tree:
    w = limits.weights(keys, t, seed)
    have = w > 0
    if not have.any():
        w, have = np.ones(len(y)), np.ones(len(y), bool)
    return grow_ranked(codes[:, have], values, y[have], w[have], limits, int(_salted(seed, t)))


# ------------------------------------------------------------------ the search
@dataclass(frozen=True)
class Candidate:
    n_trees: int
    limits: Growth


def cross_validate(df: DataFrame, candidates: list[Candidate], fold_col: str, k: int, features_col: str = "features",
                   label: str = "label", key: str | None = None, seed: int = 42, node_rows: int = NODE_ROWS,
                   broadcast_bytes: int = BROADCAST_BYTES) -> list[float]:
    """Mean RMSE over the folds of each candidate.  Candidates that differ only in
    the number of trees and the depth share one forest a fold: all are read off the
    trees of the largest."""
    spark = df.sparkSession
    shared: dict[Growth, list[int]] = {}
    for i, c in enumerate(candidates):
        shared.setdefault(replace(c.limits, max_depth=None), []).append(i)
    groups = []
    for same, members in shared.items():
        depths = [candidates[i].limits.max_depth for i in members]
        deepest = None if None in depths else max(depths)
        groups.append((replace(same, max_depth=deepest), max(candidates[i].n_trees for i in members), members))
    rows = stage_table(_rows(df, features_col, label, key, F.col(fold_col).cast("int").alias("fold")), "forest-cv")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("p"), F.count_distinct("fold").alias("k")).first()
    if facts["k"] != k:
        raise ValueError("a fold without rows: no score to choose by")
    errors: dict[tuple[int, int], tuple[float, int]] = {}
    table = _held(rows, facts["n"], facts["p"], node_rows, broadcast_bytes)
    if table is not None:
        got = _sums_in_tasks(spark, table, groups, candidates, k, seed)
    else:
        got = _sums_by_models(rows, groups, candidates, k, seed, node_rows)
    for i, f, sse, n in got:
        old = errors.get((i, f), (0.0, 0))
        errors[i, f] = (old[0] + sse, old[1] + n)
    return [float(np.mean([math.sqrt(errors[i, f][0] / errors[i, f][1]) for f in range(k)])) for i in range(len(candidates))]


def _sums_in_tasks(spark, table: tuple, groups: list, candidates: list[Candidate], k: int, seed: int, chunk: int = 10):
    """(candidate, fold, squared error, rows) with each task growing some trees of a
    fold and sending on their summed predictions of the held-out rows."""
    held = spark.sparkContext.broadcast(table)
    depths = [list(dict.fromkeys(candidates[i].limits.max_depth for i in members)) for _, _, members in groups]

    def dealt(chunk: int) -> list[tuple[int, int, int, int]]:
        # chunks end where a candidate's number of trees ends
        jobs = []
        for g, (_, most, members) in enumerate(groups):
            ends = sorted({*range(chunk, most, chunk), *(candidates[i].n_trees for i in members)})
            for f in range(k):
                jobs += [(g, f, a, b) for a, b in zip([0, *ends], ends, strict=False)]
        return sorted(jobs, key=lambda j: j[2] - j[3])  # the longest first

    jobs, cores = dealt(chunk), spark.sparkContext.defaultParallelism
    # fewer and longer jobs send less; all cores have some still
    while (chunk < max(most for _, most, _ in groups) and sum(len(depths[j[0]]) for j in jobs) * len(table[0]) // k * 8 > SUMS_BYTES
           and len(dealt(2 * chunk)) >= 2 * cores):
        chunk *= 2
        jobs = dealt(chunk)
    plain = [limits for limits, _, _ in groups]
    held_jobs = spark.sparkContext.broadcast(jobs)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, values, y, fold = held.value
        for batch in batches:
            for j in batch.column(0).to_pylist():
                g, f, a, b = held_jobs.value[j]
                train, test = fold != f, np.ascontiguousarray(codes[:, fold == f])
                total = np.zeros((len(depths[g]), test.shape[1]))
                own = keys[train], codes[:, train], values, y[train]
                for t in range(a, b):
                    total += walk_ranks(_whole_tree(*own, t, plain[g], seed), test, values, depths[g])
                for i, at in enumerate(range(0, test.shape[1], SUMS_ROWS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([g], pa.int32()), pa.array([f], pa.int32()), pa.array([i], pa.int32()), pa.array([b], pa.int32()),
                         pa.array([total[:, at:at + SUMS_ROWS].tobytes()], pa.binary())], ["g", "f", "piece", "upto", "sums"])

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *_, y, fold = held.value
        at, total = None, None
        for batch in batches:
            for g, f, piece, b, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, f, piece) != at:
                    at, total = (g, f, piece), 0.0
                    true = y[fold == f][piece * SUMS_ROWS:(piece + 1) * SUMS_ROWS]
                total = total + np.frombuffer(data).reshape(len(depths[g]), -1)
                for i in groups[g][2]:
                    if candidates[i].n_trees == b:
                        e = total[depths[g].index(candidates[i].limits.max_depth)] / b - true
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i], pa.int32()), pa.array([f], pa.int32()), pa.array([float(e @ e)]), pa.array([len(e)], pa.int64())],
                            ["i", "f", "sse", "n"])

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(task, "g int, f int, piece int, upto int, sums binary")
    rows = (sums.repartition(shuffles, "g", "f", "piece").sortWithinPartitions("g", "f", "piece", "upto")
            .mapInArrow(errors, "i int, f int, sse double, n long").orderBy("i", "f", "sse").collect())  # a row for each candidate, fold and piece
    return [(r["i"], r["f"], r["sse"], r["n"]) for r in rows]


def _sums_by_models(rows: DataFrame, groups: list, candidates: list[Candidate], k: int, seed: int, node_rows: int):
    """The same with one fitted forest a group and fold; the held-out rows go to its
    subtrees, and only their squared errors come back."""
    out = []
    rows = stage_table(rows.withColumn("id", F.monotonically_increasing_id()), "forest-cv-rows")
    for limits, most, members in groups:
        depths = list(dict.fromkeys(candidates[i].limits.max_depth for i in members))
        ends = sorted({candidates[i].n_trees for i in members})
        place = {i: ends.index(candidates[i].n_trees) * len(depths) + depths.index(candidates[i].limits.max_depth) for i in members}
        for f in range(k):
            part = rows.where(F.col("fold") != f).select("key", "x", "y")
            model = _fit_rows(part, "features", most, limits, seed, node_rows, 256, 0)
            held = rows.where(F.col("fold") == f)
            both = model.sums(held, ends, depths).join(held.select("id", "y"), "id")
            r = both.agg(F.count("*").alias("n"), *[F.sum((F.col(f"s{at}") / candidates[i].n_trees - F.col("y")) ** 2).alias(f"e{i}")
                                                    for i, at in place.items()]).first()
            out += [(i, f, r[f"e{i}"], r["n"]) for i in members]
    return out
