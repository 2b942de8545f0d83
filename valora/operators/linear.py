"""Linear regressors (M1-M6) from distributed sufficient statistics.

``gram`` makes ONE pass over the rows: every task folds its Arrow batches into
``n, sum x, sum y, sum y^2, X'X, X'y`` per fold (values shifted by the global
means for numerical stability) and emits them as (fold, cell, value) rows; a
grouped sum merges the tasks.  The driver then holds statistics whose size
depends on the feature count p, never on the row count.  Training statistics
of fold f are total - fold f, so every fold x candidate of a search - OLS,
ridge over any alpha, lasso / elastic-net paths, Bayesian ridge, per-fold
re-standardisation and held-out errors - is algebra on p x p matrices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_parallelism

_ALL = -1  # fold id of the whole table
_MISSING = -2  # rows that can't enter the statistics


# ----------------------------------------------------------------- statistics
@dataclass
class Stats:
    n: float
    sx: np.ndarray
    sy: float
    syy: float
    sxx: np.ndarray
    sxy: np.ndarray

    def __sub__(self, o: "Stats") -> "Stats":
        return Stats(self.n - o.n, self.sx - o.sx, self.sy - o.sy, self.syy - o.syy,
                     self.sxx - o.sxx, self.sxy - o.sxy)

    def __add__(self, o: "Stats") -> "Stats":
        return Stats(self.n + o.n, self.sx + o.sx, self.sy + o.sy, self.syy + o.syy,
                     self.sxx + o.sxx, self.sxy + o.sxy)

    # centred moments
    def means(self):
        return self.sx / self.n, self.sy / self.n

    def centred(self):
        mx, my = self.means()
        cxx = self.sxx - self.n * np.outer(mx, mx)
        cxy = self.sxy - self.n * mx * my
        cyy = self.syy - self.n * my * my
        return cxx, cxy, cyy


@dataclass
class Gram:
    features: list
    shift_x: np.ndarray
    shift_y: float
    folds: dict = field(default_factory=dict)   # fold id -> Stats

    @property
    def total(self) -> Stats:
        it = iter(self.folds.values())
        acc = next(it)
        for s in it:
            acc = acc + s
        return acc

    def train(self, fold) -> Stats:
        return self.total - self.folds[fold]

    def fold_ids(self):
        return sorted(self.folds)


def _layout(p: int):
    iu = np.triu_indices(p)
    return iu, 3 + 2 * p + len(iu[0])


def gram(df: DataFrame, features: Sequence[str], label: str, fold_col: str | None = None,
         shift: dict | None = None, indicators: dict | None = None, products: dict | None = None) -> Gram:
    """Per-fold sufficient statistics in one distributed pass.

    A row with a missing (null or NaN) label or feature raises: impute, or
    drop such rows, first.  ``shift``
    (column -> value) is subtracted before summing; by default the global
    means (one cheap aggregate).

    Features that ``df`` needn't have as columns are made in the tasks, without
    a shift: ``indicators`` (category column -> {level: feature}) counts by level
    in place of a column a level, ``products`` (feature -> columns) multiplies."""
    features, indicators, products = list(features), indicators or {}, products or {}
    p = len(features)
    made = {f for names in indicators.values() for f in names.values()} | set(products)
    plain = [c for c in features if c not in made]
    if shift is None:
        row = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in plain + [label]]).first()
        shift = {c: float(row[c] or 0.0) for c in plain + [label]}
    sx = np.array([0.0 if c in made else shift[c] for c in features], dtype=float)
    sy = float(shift[label])
    iu, width = _layout(p)
    levels = [list(names) for names in indicators.values()]
    factors = [[plain.index(c) for c in cs] for cs in products.values()]
    # the tasks' order: plain columns, products, then the levels of each category
    order = [*plain, *products, *[f for names in indicators.values() for f in names.values()]]
    place = np.array([order.index(c) for c in features], dtype=np.int64)
    m, w = len(plain), len(plain) + len(products)
    at = w + np.cumsum([0, *map(len, levels)])
    off = np.array([shift[c] for c in plain] + [0.0] * len(products))
    src = df.select((F.col(fold_col).cast("int") if fold_col else F.lit(_ALL)).alias("__fold"),
                    F.col(label).cast("double").alias("__y"),
                    *[F.col(c).cast("double").alias(f"__x{i}") for i, c in enumerate(plain)],
                    *[F.col(c).cast("string").alias(f"__c{i}") for i, c in enumerate(indicators)])
    src = ensure_parallelism(src)

    def part_stats(batches):
        acc: dict = {}
        missing = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fo, y, *xs = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2 + m])
            X = np.empty((batch.num_rows, w))
            for j, x in enumerate(xs):
                X[:, j] = x
            for j, cs in enumerate(factors):
                X[:, m + j] = X[:, cs[0]]
                for c in cs[1:]:
                    X[:, m + j] *= X[:, c]
            lost = np.isnan(fo) | np.isnan(y) | np.isnan(X).any(axis=1)
            missing += int(lost.sum())
            if missing:
                continue  # the whole run ends in an error
            X -= off
            y = y - sy
            # an unknown or null level is one past the last
            codes = [pc.fill_null(pc.index_in(c, value_set=pa.array(lv, c.type)), len(lv)).to_numpy(zero_copy_only=False).astype(np.int64)
                     for c, lv in zip(batch.columns[2 + m:], levels, strict=True)]
            for f in np.unique(fo):
                rows = np.flatnonzero(fo == f)
                if f not in acc:
                    acc[f] = np.zeros(3), np.zeros((2, p)), np.zeros((p, p))
                head, by_y, S = acc[f]
                Xf, yf = X[rows], y[rows]
                head += len(rows), yf.sum(), yf @ yf
                by_y[0, :w] += Xf.sum(axis=0)
                by_y[1, :w] += Xf.T @ yf
                S[:w, :w] += Xf.T @ Xf
                cf = [c[rows] for c in codes]
                for i, c in enumerate(cf):
                    n, own = len(levels[i]), slice(at[i], at[i + 1])
                    count = np.bincount(c, minlength=n + 1)[:n]
                    by_y[0, own] += count
                    by_y[1, own] += np.bincount(c, yf, n + 1)[:n]
                    S[own, own] += np.diag(count)
                    for j in range(w):
                        S[j, own] += np.bincount(c, Xf[:, j], n + 1)[:n]
                    for k in range(i):
                        r = len(levels[k])
                        both = np.bincount(cf[k] * (n + 1) + c, minlength=(r + 1) * (n + 1)).reshape(r + 1, n + 1)
                        S[at[k]:at[k + 1], own] += both[:r, :n]
        if missing:
            yield pa.RecordBatch.from_pydict({"fold": pa.array([_MISSING], pa.int32()), "cell": pa.array([0], pa.int32()),
                                              "v": [float(missing)]})
        for f, (head, by_y, S) in acc.items():
            S = np.triu(S) + np.triu(S, 1).T  # blocks below the diagonal aren't filled
            v = np.concatenate([head, by_y[0, place], by_y[1, place], S[np.ix_(place, place)][iu]])
            yield pa.RecordBatch.from_pydict({"fold": np.full(width, f, dtype=np.int32),
                                              "cell": np.arange(width, dtype=np.int32), "v": v})

    merged = (src.mapInArrow(part_stats, "fold int, cell int, v double")
              .groupBy("fold", "cell").agg(F.sum("v").alias("v"))
              .collect())  # folds x (3 + 2p + p(p+1)/2) cells: bounded by p, not rows
    vecs: dict = {}
    for r in merged:
        if r["fold"] == _MISSING:
            raise ValueError(f"{int(r['v'])} or more rows with a missing feature, label or fold")
        vecs.setdefault(r["fold"], np.zeros(width))[r["cell"]] = r["v"]
    g = Gram(features, sx, sy)
    for f, v in vecs.items():
        sxx = np.zeros((p, p))
        sxx[iu] = v[3 + 2 * p:]
        sxx = sxx + sxx.T - np.diag(np.diag(sxx))
        g.folds[f] = Stats(v[0], v[3:3 + p].copy(), v[1], v[2], sxx, v[3 + p:3 + 2 * p].copy())
    return g


# ---------------------------------------------------------------------- models
@dataclass
class LinearModel:
    features: list
    coef: np.ndarray
    intercept: float
    info: dict = field(default_factory=dict)

    def predict_col(self) -> Column:
        """Prediction as a plain SQL expression (stays in codegen)."""
        e = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coef):
            if w != 0.0:
                e = e + F.col(c).cast("double") * F.lit(float(w))
        return e

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        return df.withColumn(out, self.predict_col())

    def coefficients(self, spark) -> DataFrame:
        rows = [("intercept", float(self.intercept))] + [(c, float(w)) for c, w in zip(self.features, self.coef)]
        return spark.createDataFrame(rows, "term string, coef double")


def _scales(st: Stats, scale_mask) -> np.ndarray:
    p = len(st.sx)
    if scale_mask is None:
        return np.ones(p)
    cxx, _, _ = st.centred()
    sd = np.sqrt(np.maximum(np.diag(cxx) / st.n, 0.0))
    sd[sd == 0] = 1.0
    return np.where(np.asarray(scale_mask, dtype=bool), sd, 1.0)


def _design(st: Stats, g: Gram, intercept: bool, scale_mask):
    """Normal-equation pieces in the (possibly standardised) coordinates of
    the training statistics ``st``.  Returns (A, b, d, centre) where the model
    is  pred = intercept + ((x - centre) / d) . w_s."""
    d = _scales(st, scale_mask)
    mx, my = st.means()                       # shifted coordinates
    if intercept:
        cxx, cxy, _ = st.centred()
        A, b = cxx, cxy
        centre = mx
    else:
        mask = np.zeros(len(d), bool) if scale_mask is None else np.asarray(scale_mask, bool)
        centre = np.where(mask, mx, -g.shift_x)  # unscaled columns: raw value (shifted back)
        e = -centre
        A = st.sxx + np.outer(st.sx, e) + np.outer(e, st.sx) + st.n * np.outer(e, e)
        b = st.sxy + e * st.sy + st.sx * g.shift_y + st.n * e * g.shift_y
    A = A / np.outer(d, d)
    b = b / d
    return A, b, d, centre


def _finish(g: Gram, st: Stats, w_s, d, centre, intercept: bool, info=None) -> LinearModel:
    w = w_s / d
    mx, my = st.means()
    if intercept:
        b0 = (my + g.shift_y) - float((mx + g.shift_x) @ w)
    else:
        b0 = -float((centre + g.shift_x) @ w)
    return LinearModel(list(g.features), w, b0, dict(info or {}))


def fit_ridge(g: Gram, alpha: float = 0.0, intercept: bool = True, scale_mask=None,
              stats: Stats | None = None) -> LinearModel:
    """M1 (alpha=0, minimum-norm least squares) and M2 (ridge):
    ``min ||y - Xw - b||^2 + alpha ||w||^2`` on the training statistics;
    ``scale_mask`` marks columns standardised with the training mean and
    population sd (a scaler refit on exactly these rows)."""
    st = stats if stats is not None else g.total
    A, b, d, centre = _design(st, g, intercept, scale_mask)
    p = len(b)
    if alpha > 0:
        w_s = np.linalg.solve(A + alpha * np.eye(p), b)
    else:
        w_s = np.linalg.lstsq(A, b, rcond=None)[0]
    return _finish(g, st, w_s, d, centre, intercept, {"alpha": alpha, "fit_intercept": intercept})


def sse(g: Gram, st: Stats, m: LinearModel) -> float:
    """Sum of squared errors of ``m`` over the rows summarised by ``st``."""
    w = m.coef
    c = g.shift_y - m.intercept - float(g.shift_x @ w)
    val = (st.syy - 2 * w @ st.sxy + w @ st.sxx @ w + 2 * c * (st.sy - w @ st.sx) + st.n * c * c)
    return float(max(val, 0.0))


def soft(z, t):
    return np.sign(z) * np.maximum(np.abs(z) - t, 0.0)


def _cd(G, c, alpha, l1_ratio, w0=None, max_iter=10_000, tol=1e-4):
    """Covariance-update coordinate descent for
    1/(2n)||y - Xw||^2 + alpha*r*|w|_1 + alpha*(1-r)/2*|w|^2 with G = X'X/n,
    c = X'y/n (Friedman, Hastie & Tibshirani 2010), with active-set
    iterations: after a full sweep only the non-zero coefficients are cycled
    until they settle, then a full sweep checks the rest."""
    import math
    p = len(c)
    w = np.zeros(p) if w0 is None else w0.copy()
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    diag = np.diag(G).tolist()
    Gt = np.ascontiguousarray(G.T)          # Gt[j] = column j, contiguous
    grad = c - G @ w
    tmp = np.empty(p)

    def sweep(idx):
        wmax = dmax = 0.0
        for j in idx:
            dj = diag[j]
            if dj == 0:
                continue
            old = float(w[j])
            rho = float(grad[j]) + dj * old
            a = abs(rho) - l1
            new = math.copysign(a, rho) / (dj + l2) if a > 0 else 0.0
            if new != old:
                np.multiply(Gt[j], new - old, out=tmp)
                np.subtract(grad, tmp, out=grad)
                w[j] = new
                dmax = max(dmax, abs(new - old))
            wmax = max(wmax, abs(new))
        return wmax, dmax

    it = 0
    full = range(p)
    for it in range(max_iter):
        wmax, dmax = sweep(full)
        if wmax == 0 or dmax / wmax < tol:
            break
        active = np.nonzero(w)[0]
        for _ in range(max_iter):
            wmax, dmax = sweep(active)
            if wmax == 0 or dmax / wmax < tol:
                break
    return w, it + 1


def alpha_grid(g: Gram, l1_ratio: float = 1.0, n_alphas: int = 100, eps: float = 1e-3,
               scale_mask=None, stats: Stats | None = None) -> np.ndarray:
    """Descending log-spaced alphas from alpha_max = max|X'y|/(n r)."""
    st = stats if stats is not None else g.total
    A, b, d, _ = _design(st, g, True, scale_mask)
    amax = np.max(np.abs(b)) / (st.n * max(l1_ratio, 1e-3))
    if amax <= 0:
        return np.full(n_alphas, eps)
    return np.logspace(np.log10(amax), np.log10(amax * eps), n_alphas)


def fit_elastic_net(g: Gram, alpha: float, l1_ratio: float = 1.0, scale_mask=None,
                    stats: Stats | None = None, w0=None, max_iter=10_000, tol=1e-4) -> LinearModel:
    """M4 (l1_ratio=1: lasso) / M5 with intercept."""
    st = stats if stats is not None else g.total
    A, b, d, centre = _design(st, g, True, scale_mask)
    w_s, n_iter = _cd(A / st.n, b / st.n, alpha, l1_ratio, w0, max_iter, tol)
    m = _finish(g, st, w_s, d, centre, True, {"alpha": alpha, "l1_ratio": l1_ratio, "n_iter": n_iter})
    m.info["w_s"] = w_s
    return m


def _solve_paths(folds: dict, payload: dict, max_iter: int, tol: float, spark=None) -> dict:
    """Warm-started coordinate-descent paths, one per key of ``payload``
    ({key: (fold, alphas, l1_ratio)}) over the folds' (G, c).  The paths are
    independent, so with a session they run as parallel Spark tasks (each fold's
    p x p input travels once, in one broadcast; only coefficient vectors come
    back); without one, locally."""

    def one(G, c, alphas, r):
        w, out = None, []
        for a in alphas:
            w, _ = _cd(G, c, float(a), r, w, max_iter, tol)
            out.append(w.copy())
        return out

    keys = sorted(payload)
    if spark is None or len(keys) == 1:
        return {k: one(*folds[payload[k][0]], *payload[k][1:]) for k in keys}
    bc = spark.sparkContext.broadcast((folds, payload))

    def run(batches):
        for pdf in batches:
            for k in pdf["k"]:
                all_folds, points = bc.value
                f, alphas, r = points[int(k)]
                ws = one(*all_folds[f], alphas, r)
                yield pd.DataFrame({"k": np.full(len(ws), k, dtype=np.int32),
                                    "i": np.arange(len(ws), dtype=np.int32), "w": [list(x) for x in ws]})

    # exactly one path per task
    jobs = spark.range(0, len(keys), 1, numPartitions=len(keys)).select(
        F.element_at(F.array(*[F.lit(int(k)) for k in keys]), (F.col("id") + 1).cast("int")).alias("k"))
    got: dict = {k: [None] * len(payload[k][1]) for k in keys}
    for row in jobs.mapInPandas(run, "k int, i int, w array<double>").collect():  # paths x alphas x p
        got[row["k"]][row["i"]] = np.array(row["w"])
    bc.unpersist()
    return got


def elastic_net_path(g: Gram, l1_ratios=(1.0,), n_alphas=100, eps=1e-3, scale_mask=None,
                     max_iter=10_000, tol=1e-4, spark=None) -> tuple[pd.DataFrame, LinearModel]:
    """M4/M5 with cross-validation over the folds of ``g``: for every
    (l1-ratio, fold) the alpha path is solved with warm starts (paths run as
    parallel tasks when a session is active), the held-out MSE per
    (ratio, alpha) picks the best by mean MSE, and the model is refit on all
    rows.  Returns (path table, best model)."""
    from pyspark.sql import SparkSession
    spark = spark or SparkSession.getActiveSession()
    combos = [(r, f) for r in l1_ratios for f in g.fold_ids()]
    by_fold = {f: _design(g.train(f), g, True, scale_mask) for f in g.fold_ids()}
    designs = [by_fold[f] for _, f in combos]
    grids = {r: alpha_grid(g, r, n_alphas, eps, scale_mask) for r in l1_ratios}
    inputs = {f: (x[0] / g.train(f).n, x[1] / g.train(f).n) for f, x in by_fold.items()}
    payload = {b: (f, grids[r], float(r)) for b, (r, f) in enumerate(combos)}
    paths = _solve_paths(inputs, payload, max_iter, tol, spark)
    rows = []
    for b, (r, f) in enumerate(combos):
        _, _, d, centre = designs[b]
        va = g.folds[f]
        for i, w in enumerate(paths[b]):
            m = _finish(g, g.train(f), w, d, centre, True)
            rows.append((float(r), i, float(grids[r][i]), int(f), sse(g, va, m) / va.n))
    path = pd.DataFrame(rows, columns=["l1_ratio", "alpha_idx", "alpha", "fold", "mse"])
    mean = path.groupby(["l1_ratio", "alpha_idx", "alpha"], as_index=False)["mse"].mean()
    best = mean.sort_values(["mse", "l1_ratio", "alpha_idx"]).iloc[0]
    # refit on all rows, warm-started from a fold solution at the chosen point
    b0 = next(b for b, (r, _) in enumerate(combos) if r == float(best["l1_ratio"]))
    model = fit_elastic_net(g, float(best["alpha"]), float(best["l1_ratio"]), scale_mask,
                            w0=paths[b0][int(best["alpha_idx"])], max_iter=max_iter, tol=tol)
    return path, model


def fit_bayes_ridge(g: Gram, max_iter: int = 300, tol: float = 1e-3, scale_mask=None,
                    stats: Stats | None = None, a1=1e-6, a2=1e-6, l1=1e-6, l2=1e-6) -> LinearModel:
    """M6: Bayesian ridge with Gamma priors on the noise precision alpha and
    weight precision lambda, re-estimated by evidence maximisation (MacKay
    1992) on the eigen-decomposition of the centred X'X."""
    st = stats if stats is not None else g.total
    A, b, d, centre = _design(st, g, True, scale_mask)
    _, _, cyy = st.centred()
    n = st.n
    s, V = np.linalg.eigh(A)
    s = np.maximum(s, 0.0)
    Vtb = V.T @ b
    alpha_ = 1.0 / (cyy / n + np.finfo(np.float64).eps)
    lambda_ = 1.0

    def coef(al, la):
        w = V @ (Vtb / (s + la / al))
        ssr = cyy - 2 * w @ b + w @ A @ w
        return w, max(ssr, 0.0)

    w_old = None
    it = 0
    for it in range(max_iter):
        w, ssr = coef(alpha_, lambda_)
        gamma = np.sum(alpha_ * s / (lambda_ + alpha_ * s))
        lambda_ = (gamma + 2 * l1) / (w @ w + 2 * l2)
        alpha_ = (n - gamma + 2 * a1) / (ssr + 2 * a2)
        if it != 0 and np.sum(np.abs(w_old - w)) < tol:
            break
        w_old = w.copy()
    w, _ = coef(alpha_, lambda_)
    return _finish(g, st, w, d, centre, True,
                   {"alpha_": float(alpha_), "lambda_": float(lambda_), "n_iter": it + 1})


# ------------------------------------------------------------------ LOO (M3)
def loo_residuals(df: DataFrame, g: Gram, model: LinearModel, label: str, key: str,
                  alpha: float = 0.0, scale_mask=None, intercept: bool = True) -> DataFrame:
    """Exact leave-one-out residuals of OLS/ridge: r_i / (1 - h_ii) with h_ii =
    z_i (Z'Z + alpha I)^-1 z_i', plus 1/n with an intercept, on centred
    (optionally standardised) features; without one, unscaled columns aren't
    centred.  One projection pass; the p x p
    inverse is shipped with the task closure (size bounded by p)."""
    st = g.total
    A, _, d, centre = _design(st, g, intercept, scale_mask)
    p = len(d)
    M = np.linalg.pinv(A + alpha * np.eye(p)) if p else np.zeros((0, 0))
    mean_raw = centre + g.shift_x
    base = 1.0 / st.n if intercept else 0.0
    feats = list(g.features)
    w, b0 = model.coef, model.intercept

    def lev(batches):
        for pdf in batches:
            X = pdf[feats].to_numpy(dtype=np.float64)
            Z = (X - mean_raw) / d
            h = base + np.einsum("ij,jk,ik->i", Z, M, Z)
            pred = b0 + X @ w
            r = pdf[label].to_numpy(dtype=np.float64) - pred
            yield pd.DataFrame({key: pdf[key], "prediction": pred, "residual": r,
                                "leverage": h, "loo_residual": r / (1.0 - h)})

    key_type = df.schema[key].dataType.simpleString()
    return (df.select(key, *[F.col(c).cast("double").alias(c) for c in feats],
                      F.col(label).cast("double").alias(label))
            .mapInPandas(lev, f"{key} {key_type}, prediction double, residual double, "
                              "leverage double, loo_residual double"))


def loo_summary(resid: DataFrame) -> DataFrame:
    """``loo_mae`` (what the reference reports as its LOO 'RMSE': the mean of
    one-point RMSEs) and the true ``loo_rmse``."""
    return resid.agg(F.count(F.lit(1)).alias("n"),
                     F.avg(F.abs("loo_residual")).alias("loo_mae"),
                     F.sqrt(F.avg(F.col("loo_residual") ** 2)).alias("loo_rmse"))


# ------------------------------------------------------- fold-wise evaluation
def evaluate_candidates(g: Gram, candidates: Sequence[dict], scale_mask=None) -> pd.DataFrame:
    """Held-out RMSE (in the fitted scale) of every candidate on every fold.
    Candidate keys: ``kind`` ('ols', 'ridge', 'lasso', 'enet', 'bayes'),
    ``alpha``, ``fit_intercept``, ``l1_ratio``, ``max_iter``."""
    rows = []
    for ci, cand in enumerate(candidates):
        for f in g.fold_ids():
            tr, va = g.train(f), g.folds[f]
            m = fit_candidate(g, cand, scale_mask, tr)
            rows.append((ci, int(f), float(np.sqrt(sse(g, va, m) / va.n)), float(va.n)))
    return pd.DataFrame(rows, columns=["candidate", "fold", "rmse", "n"])


def fit_candidate(g: Gram, cand: dict, scale_mask=None, stats: Stats | None = None) -> LinearModel:
    kind = cand.get("kind", "ridge")
    if kind in ("ols", "ridge"):
        return fit_ridge(g, float(cand.get("alpha", 0.0)) if kind == "ridge" else 0.0,
                         bool(cand.get("fit_intercept", True)), scale_mask, stats)
    if kind in ("lasso", "enet"):
        return fit_elastic_net(g, float(cand["alpha"]), float(cand.get("l1_ratio", 1.0)), scale_mask, stats)
    if kind == "bayes":
        return fit_bayes_ridge(g, int(cand.get("max_iter", 300)), scale_mask=scale_mask, stats=stats)
    raise ValueError(kind)
