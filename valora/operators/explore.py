"""Exploratory aggregations (A1-A12).  Each is one scan with partial
aggregation; the driver receives results sized by the column count or the
group count, never by the row count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles

_REL_CONST = 1e-13  # sd / |mean| below this: numerically constant column


def _number(c: str):
    return F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))


def corr_matrix(df: DataFrame, cols: Sequence[str], upper_only: bool = False,
                wide_from: int = 24) -> DataFrame:
    """A1: Pearson correlation of every column pair, long form ``(a, b, r)``.

    Pairwise-complete (a row counts for a pair when both values are present)
    and null - not an ANSI divide error - when a column is constant.  Up to
    ``wide_from`` columns one SQL aggregate holds all pairs; wider tables use
    one ``mapInPandas`` pass of four p x p matrix products (``_corr_wide``),
    since thousands of aggregate expressions would not compile well.  Either
    way a single scan serves the whole matrix."""
    cols = list(cols)
    # a NaN is a missing value, like null
    df = df.select(*[_number(c).alias(c) for c in dict.fromkeys(cols)])
    if len(cols) > wide_from:
        return _corr_wide(df, cols, upper_only)
    # cheap first pass: which columns hold nulls.  Pairs of null-free columns
    # share per-column mean/sd; only pairs touching a nullable column need
    # pair-masked moments (keeps the aggregate small enough for codegen)
    cnt = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(F.col(c)).alias(f"n{i}")
                                                   for i, c in enumerate(cols)]).first()
    full = {c for i, c in enumerate(cols) if cnt[f"n{i}"] == cnt["__n"]}
    aggs = []
    for i, c in enumerate(cols):
        if c in full:
            x = F.col(c).cast("double")
            aggs += [F.avg(x).alias(f"m_{i}"), F.stddev_pop(x).alias(f"s_{i}")]
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i or (upper_only and i == j):
                continue
            k = len(pairs)
            xa, xb = F.col(a).cast("double"), F.col(b).cast("double")
            if a in full and b in full:
                aggs.append(F.covar_pop(xa, xb).alias(f"c{k}"))
                pairs.append((a, b, (f"s_{i}", f"s_{j}", f"m_{i}", f"m_{j}")))
            else:
                both = xa.isNotNull() & xb.isNotNull()
                ma, mb = F.when(both, xa), F.when(both, xb)
                aggs += [F.covar_pop(ma, mb).alias(f"c{k}"), F.stddev_pop(ma).alias(f"sa{k}"),
                         F.stddev_pop(mb).alias(f"sb{k}"), F.avg(ma).alias(f"ma{k}"), F.avg(mb).alias(f"mb{k}")]
                pairs.append((a, b, (f"sa{k}", f"sb{k}", f"ma{k}", f"mb{k}")))
    wide = df.agg(*aggs)
    entries = []
    for k, (a, b, (sa, sb, ma, mb)) in enumerate(pairs):
        # a column is constant when its sd is at rounding level of its mean
        # (merged partial buffers leave ~1e-16 noise instead of an exact 0)
        const = ((F.col(sa) <= F.lit(_REL_CONST) * F.abs(F.col(ma)))
                 | (F.col(sb) <= F.lit(_REL_CONST) * F.abs(F.col(mb))))
        r = F.when(~const, F.try_divide(F.col(f"c{k}"), F.nullif(F.col(sa) * F.col(sb), F.lit(0.0))))
        # clamp rounding noise (|r| can exceed 1 by an ulp); greatest/least
        # skip nulls, so keep a null r null explicitly
        r = F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
        entries.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r.alias("r")))
        if a != b and not upper_only:
            entries.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), r.alias("r")))
    return wide.select(F.explode(F.array(*entries)).alias("e")).select("e.a", "e.b", "e.r")


def _corr_wide(df: DataFrame, cols: list, upper_only: bool) -> DataFrame:
    import numpy as np
    import pandas as pd

    from ..session import ensure_parallelism
    p = len(cols)
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    mu = np.array([row[f"m{i}"] or 0.0 for i in range(p)])  # shift: stability only
    names = [f"__c{i}" for i in range(p)]
    src = ensure_parallelism(df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]))

    def part(batches):
        acc = None
        for pdf in batches:
            X = pdf[names].to_numpy(dtype=np.float64) - mu
            M = (~np.isnan(X)).astype(np.float64)
            X0 = np.where(M > 0, X, 0.0)
            mats = np.stack([M.T @ M, X0.T @ M, (X0 * X0).T @ M, X0.T @ X0])
            acc = mats if acc is None else acc + mats
        if acc is not None:
            yield pd.DataFrame({"cell": np.arange(acc.size, dtype=np.int64), "v": acc.ravel()})

    got = (src.mapInPandas(part, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v"))
           .collect())  # 4 p^2 cells: bounded by the column count
    acc = np.zeros(4 * p * p)
    for r in got:
        acc[r["cell"]] = r["v"]
    n, s, q, pr = acc.reshape(4, p, p)  # s[i,j] = sum of x_i where x_i and x_j present
    rows = []
    for i in range(p):
        for j in range(p):
            if (upper_only and j <= i):
                continue
            nij = n[i, j]
            va = nij * q[i, j] - s[i, j] ** 2
            vb = nij * q[j, i] - s[j, i] ** 2
            cov = nij * pr[i, j] - s[i, j] * s[j, i]
            r = None
            ma, mb = s[i, j] / nij + mu[i] if nij else 0.0, s[j, i] / nij + mu[j] if nij else 0.0
            const = (va <= (_REL_CONST * nij * ma) ** 2) or (vb <= (_REL_CONST * nij * mb) ** 2)
            if nij > 0 and va > 0 and vb > 0 and not const:
                r = float(min(1.0, max(-1.0, cov / np.sqrt(va * vb))))
            rows.append((cols[i], cols[j], r))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def corr_rank(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """A2: correlation of each column with ``target``, ranked by |r| desc (ties
    by name), nulls dropped.  ``rank`` 0 is the target itself."""
    cols = [target] + [c for c in cols if c != target]
    aggs, entries = [], []
    y = _number(target)
    for i, c in enumerate(cols):  # the target's row of the matrix only, in one aggregate
        x = _number(c)
        xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
        aggs += [F.covar_pop(xm, ym).alias(f"c{i}")]
        for n, v in (("x", xm), ("y", ym)):
            aggs += [F.stddev_pop(v).alias(f"s{n}{i}"), F.avg(v).alias(f"m{n}{i}")]
        flat = (F.col(f"sx{i}") <= _REL_CONST * F.abs(f"mx{i}")) | (F.col(f"sy{i}") <= _REL_CONST * F.abs(f"my{i}"))
        r = F.when(~flat, F.try_divide(F.col(f"c{i}"), F.nullif(F.col(f"sx{i}") * F.col(f"sy{i}"), F.lit(0.0))))
        r = F.when(r.isNotNull(), F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
        entries.append(F.struct(F.lit(c).alias("b"), r.alias("r")))
    m = df.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.b", "e.r").where("r is not null")
    w = Window.orderBy(F.abs("r").desc(), F.when(F.col("feature") == target, 0).otherwise(1), F.col("feature"))
    return m.select(F.col("b").alias("feature"), "r").withColumn("rank", F.row_number().over(w) - 1)


def corr_topk(df: DataFrame, cols: Sequence[str], target: str, k: int = 10) -> DataFrame:
    """A3: the target plus the ``k`` features most correlated with it (the
    rest is ``rank > k``)."""
    return corr_rank(df, cols, target).where(F.col("rank") <= k)


def corr_submatrix(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """A4: the matrix restricted to ``keep``."""
    keep = list(keep)
    return corr_matrix(df, keep)


def corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.85) -> DataFrame:
    """Pairs (upper triangle) with |r| above ``threshold``."""
    return (corr_matrix(df, cols, upper_only=True)
            .where(F.abs("r") > F.lit(threshold)))


def prune_correlated(df: DataFrame, cols: Sequence[str], threshold: float = 0.85,
                     keep: Sequence[str] = ()) -> tuple[DataFrame, list]:
    """P3 data-driven: drop the second column of every pair above the
    threshold (unless listed in ``keep``)."""
    order = {c: i for i, c in enumerate(cols)}
    drop = set()
    for r in corr_pairs(df, cols, threshold).collect():  # pairs of columns: bounded by p^2
        a, b = sorted([r["a"], r["b"]], key=order.get)
        if a in drop or b in drop:
            continue
        victim = a if b in keep else b
        if victim not in keep:
            drop.add(victim)
    return df.drop(*drop), sorted(drop)


def cardinality(df: DataFrame, cols: Sequence[str], lo: int = 2, hi: int = 50) -> DataFrame:
    """Distinct non-null count per column and the plot gate
    ``lo <= n <= hi``.  The (column, value) pairs are de-duplicated map-side,
    so a low-cardinality column costs almost no shuffle."""
    cols = list(cols)
    long = (df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols])).alias("kv"))
        .select("kv.column", "kv.v").where(F.col("v").isNotNull()).distinct())
    counts = long.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return (names.join(counts, "column", "left")
            .select("column", F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"))
            .withColumn("kept", ((F.col("n_distinct") >= lo) & (F.col("n_distinct") <= hi)).cast("int")))


def group_median(df: DataFrame, by: str, y: str) -> DataFrame:
    """Exact median of ``y`` per group (null keys dropped), ordered by the
    median as the box-plot order."""
    q = exact_quantiles(df, y, [0.5], by=[by])
    return q.select(by, F.col("quantile").alias("median")).orderBy("median", by)


def _quartiles(df: DataFrame, by: Sequence[str], y: str) -> DataFrame:
    q = exact_quantiles(df, y, [0.25, 0.5, 0.75], by=by)
    wide = q.groupBy(*by).agg(
        F.max(F.when(F.col("prob") == 0.25, F.col("quantile"))).alias("q1"),
        F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.75, F.col("quantile"))).alias("q3"))
    return wide.withColumn("iqr", F.col("q3") - F.col("q1"))


def box_stats(df: DataFrame, by, y: str, whisker: float = 1.5) -> DataFrame:
    """Per group quartiles, IQR, whiskers (furthest point within
    ``whisker`` IQR of the box) and the flier count.  ``by`` is a column name
    or a list of them (e.g. ``["column", "level"]`` over an unpivoted table, so
    one run serves every categorical column)."""
    by = [by] if isinstance(by, str) else list(by)
    wide = _quartiles(df, by, y)
    lo = F.col("q1") - F.lit(whisker) * F.col("iqr")
    hi = F.col("q3") + F.lit(whisker) * F.col("iqr")
    v = F.col(y).cast("double")
    keys = F.lit(True)
    for b in by:
        keys = keys & F.col(b).isNotNull()
    joined = df.select(*by, y).where(keys & v.isNotNull()).join(wide, by)
    inside = v.between(lo, hi)
    agg = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(inside, v)).alias("whisker_lo"),
        F.max(F.when(inside, v)).alias("whisker_hi"),
        F.sum(F.when(inside, 0).otherwise(1)).cast("long").alias("n_fliers"))
    return wide.join(agg, by)


def box_stats_by_columns(df: DataFrame, cols, y: str, whisker: float = 1.5) -> DataFrame:
    """A9 for several categorical columns at once: the table is unpivoted to
    ``(column, level, y)`` and one grouped run answers every column."""
    long = (df.select(F.col(y).cast("double").alias(y), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in cols])).alias("kv"))
        .select("kv.column", "kv.level", y))
    return box_stats(long, ["column", "level"], y, whisker)


def fliers(df: DataFrame, by: str, y: str, key: str, whisker: float = 1.5) -> DataFrame:
    """The flier rows themselves (rows outside the whiskers)."""
    s = _quartiles(df, [by], y).select(by, "q1", "q3", "iqr")
    v = F.col(y).cast("double")
    return (df.select(key, by, y).join(s, by)
            .where(~v.between(F.col("q1") - whisker * F.col("iqr"), F.col("q3") + whisker * F.col("iqr")))
            .select(key, by, y))


def scatter_bins(df: DataFrame, x: str, y: str, n: int = 20) -> DataFrame:
    """A10: 2-D histogram of (x, y) on an n x n equal-width grid over the data
    range: the scatter plot's data at any row count."""
    rng = df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).first()

    def b(c, lo, hi):
        if lo is None or hi is None or hi == lo:
            return F.lit(0)
        raw = F.floor((F.col(c).cast("double") - F.lit(float(lo))) / F.lit(float(hi - lo)) * F.lit(n))
        return F.least(raw, F.lit(n - 1)).cast("int")

    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .select(b(x, rng["x0"], rng["x1"]).alias("x_bin"), b(y, rng["y0"], rng["y1"]).alias("y_bin"))
            .groupBy("x_bin", "y_bin").agg(F.count(F.lit(1)).alias("n")))


def compare_runs(a: DataFrame, b: DataFrame, key: str, col: str = "prediction") -> DataFrame:
    """Join two prediction tables on the key; mean absolute difference,
    value ranges of both, and the count of unmatched keys."""
    j = (a.select(key, F.col(col).alias("__a"))
         .join(b.select(key, F.col(col).alias("__b")), key, "full_outer"))
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return j.agg(
        F.sum(F.when(both, 1).otherwise(0)).cast("long").alias("n_matched"),
        F.sum(F.when(both, 0).otherwise(1)).cast("long").alias("n_unmatched"),
        F.avg(F.when(both, F.abs(F.col("__a") - F.col("__b")))).alias("mean_abs_diff"),
        F.max(F.when(both, F.abs(F.col("__a") - F.col("__b")))).alias("max_abs_diff"),
        F.min("__a").alias("min_a"), F.avg("__a").alias("mean_a"), F.max("__a").alias("max_a"),
        F.min("__b").alias("min_b"), F.avg("__b").alias("mean_b"), F.max("__b").alias("max_b"))
