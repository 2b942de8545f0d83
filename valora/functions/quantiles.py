"""Exact, interpolated quantiles that survive skew.

Semantics: for a group of ``n`` non-null values sorted ``x[0..n-1]`` and a
probability ``q``, ``pos = q*(n-1)``; the result is ``x[floor(pos)] +
(x[ceil(pos)] - x[floor(pos)]) * (pos - floor(pos))`` (pandas/numpy
``linear``, SQL ``quantile_cont``/``percentile_cont``).

Why not ``F.percentile``/``F.median``: those keep a value->count map of the
whole group in one aggregation buffer, so a hot group with billions of distinct
values lands in one task.  Here every pass is a scan plus a *partial*
aggregation into at most ``buckets`` histogram cells per (group, bracket):

1. one aggregate gives ``n, min, max`` per group;
2. each pass splits every open bracket ``[lo, hi]`` into buckets, of equal width
   and of equal ratio in turn, counts rows per bucket (map-side combined), and keeps the bucket holding the
   wanted rank, tightened to its own ``[min, max]``;
3. when a bracket holds at most ``leaf_rows`` rows (or one distinct value) the
   exact order statistic is read from those few rows.

Two passes shrink a bracket by a factor near ``buckets`` in width and in ratio,
so the number of passes is logarithmic in the value resolution, never in ``n``;
it has no limit, and no bracket above ``leaf_rows`` is ever read.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_V = "__v"


def _signed_log(v):
    """Monotone map of any finite double to about +-1460: a bin of it spans a
    constant ratio, however many decades the values cover."""
    size = F.log(F.abs(v)) + F.lit(746.0)
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0.0))


def _bucket(v, lo, hi, buckets: int, by_ratio: bool):
    """Histogram cell of ``v`` in ``[lo, hi]``: ``lo`` falls into the first and
    ``hi`` into the last, so every pass separates them.  Infinite ends have the
    outermost cells to themselves; halving keeps huge widths finite.  Passes by
    equal width and by equal ratio take turns, which bounds their number
    whatever the spread of the values."""
    inf = float("inf")
    low = F.when(lo == -inf, F.lit(-1.7976931348623157e308)).otherwise(lo)
    high = F.when(hi == inf, F.lit(1.7976931348623157e308)).otherwise(hi)
    if by_ratio:
        share = (_signed_log(v) - _signed_log(low)) / (_signed_log(high) - _signed_log(low))
    else:
        share = (v / 2 - low / 2) / (high / 2 - low / 2)
    inner = F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * F.lit(float(buckets - 2))).cast("int") + 1
    inner = F.least(F.greatest(inner, F.lit(1)), F.lit(buckets - 2))
    return F.when(v <= lo, 0).when(v >= hi, buckets - 1).otherwise(inner)


def _rank_targets(n: int, probs):
    out = []
    for q in probs:
        pos = float(q) * (n - 1)
        r0 = int(pos // 1)
        frac = pos - r0
        r1 = min(r0 + 1, n - 1) if frac > 0 else r0
        out.append((q, r0, r1, frac))
    return out


def _interp(v0: float, v1: float, frac: float) -> float:
    return v0 if frac == 0 or v0 == v1 else v0 + (v1 - v0) * frac


def _columns(df: DataFrame, cols, probs, buckets: int, leaf_rows: int) -> dict:
    """Exact quantiles of several columns at once; the bracket state (a few
    numbers per column) lives on the driver and enters the plan as literals,
    so every pass is ONE scan with map-side aggregation and no join."""
    cols = list(cols)
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c).cast("double")
        ok = v.isNotNull() & ~F.isnan(v)
        aggs += [F.count(F.when(ok, 1)).alias(f"n{i}"), F.min(F.when(ok, v)).alias(f"lo{i}"),
                 F.max(F.when(ok, v)).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    out, targets, state = {}, {}, {}
    for i, c in enumerate(cols):
        n = int(row[f"n{i}"])
        if n == 0:
            out[c] = {float(q): None for q in probs}
            continue
        targets[i] = _rank_targets(n, probs)
        for _, r0, r1, _ in targets[i]:
            for r in (r0, r1):
                state[(i, r)] = (float(row[f"lo{i}"]), float(row[f"hi{i}"]), 0, n)

    def brackets(open_only: bool):
        return sorted({(i, lo, hi, below) for (i, _), (lo, hi, below, cnt) in state.items()
                       if lo < hi and (cnt > leaf_rows or not open_only)})

    def emit(bl, with_bucket: bool, by_ratio: bool = False):
        items = []
        for b, (i, lo, hi, _) in enumerate(bl):
            v = F.col(cols[i]).cast("double")
            fields = [F.lit(b).alias("b"), v.alias(_V)]
            if with_bucket:
                k = _bucket(v, F.lit(lo), F.lit(hi), buckets, by_ratio)
                fields.append(k.alias("k"))
            items.append(F.when(v.between(F.lit(lo), F.lit(hi)), F.struct(*fields)))
        return (df.select(F.explode(F.array(*items)).alias("e")).where(F.col("e").isNotNull())
                .select("e.*"))

    turn = 0
    while bl := brackets(True):
        turn += 1
        hist = (emit(bl, True, turn % 2 == 0).groupBy("b", "k")
                .agg(F.count(F.lit(1)).alias("c"), F.min(_V).alias("mn"), F.max(_V).alias("mx"))
                .collect())  # at most len(bl) * buckets rows
        by_b: dict = {}
        for h in hist:
            by_b.setdefault(h["b"], []).append((h["k"], h["c"], h["mn"], h["mx"]))
        for key, (lo, hi, below, cnt) in list(state.items()):
            if not (cnt > leaf_rows and lo < hi):
                continue
            acc = below
            for _, c, mn, mx in sorted(by_b[bl.index((key[0], lo, hi, below))]):
                if acc <= key[1] < acc + c:
                    state[key] = (float(mn), float(mx), acc, int(c))
                    break
                acc += c
    bl = brackets(False)
    got: dict = {}
    if bl:
        for rr in emit(bl, False).collect():  # <= leaf_rows values per bracket
            got.setdefault(rr["b"], []).append(rr[_V])
        for lst in got.values():
            lst.sort()
    for i, tl in targets.items():
        vals = {}
        for _, r0, r1, _ in tl:
            for r in (r0, r1):
                lo, hi, below, _ = state[(i, r)]
                vals[r] = lo if lo == hi else got[bl.index((i, lo, hi, below))][r - below]
        out[cols[i]] = {float(q): _interp(vals[r0], vals[r1], frac) for q, r0, r1, frac in tl}
    return out


def _global(base: DataFrame, probs, buckets: int, leaf_rows: int) -> dict:
    return _columns(base, [_V], probs, buckets, leaf_rows)[_V]


def _small_or_checkpoint(df: DataFrame, limit: int):
    """Materialise a small state table: collected and re-created as a local
    relation when it has at most ``limit`` rows (a proven bound), otherwise a
    reliable checkpoint.  Either way the lineage is cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema), rows, True
    return cut_lineage(df), None, False


def _grouped(base: DataFrame, by: list[str], probs, buckets: int, leaf_rows: int,
             broadcast_rows: int) -> DataFrame:
    stats = base.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min(_V).alias("__lo"),
                                  F.max(_V).alias("__hi"))
    tg = (stats.select(*by, "__n", "__lo", "__hi",
                       F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("__q"))
          .withColumn("__pos", F.col("__q") * (F.col("__n") - 1))
          .withColumn("__r0", F.floor("__pos").cast("long"))
          .withColumn("__frac", F.col("__pos") - F.col("__r0"))
          .withColumn("__r1", F.least(F.col("__r0") + F.when(F.col("__frac") > 0, 1).otherwise(0),
                                      F.col("__n") - 1)))
    tg, tg_rows, small = _small_or_checkpoint(tg, broadcast_rows)  # one row per (group, prob)
    if small and all(r["__n"] <= leaf_rows for r in tg_rows):
        return _all_small(base, by, tg)

    def side(df):
        return F.broadcast(df) if small else df

    br = (tg.select(*by, F.explode(F.array("__r0", "__r1")).alias("__rank"), "__lo", "__hi",
                    F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__cnt"))
          .distinct())
    is_open = (F.col("__cnt") > leaf_rows) & (F.col("__lo") < F.col("__hi"))
    any_open = (any(r["__n"] > leaf_rows and r["__lo"] < r["__hi"] for r in tg_rows)
                if small else not br.where(is_open).isEmpty())
    turn = 0
    while any_open:
        turn += 1
        act = br.where(is_open)
        bk = act.select(*by, "__lo", "__hi").distinct()
        rows = (base.join(side(bk), on=by)
                .where(F.col(_V).between(F.col("__lo"), F.col("__hi")))
                .withColumn("__k", _bucket(F.col(_V), F.col("__lo"), F.col("__hi"), buckets, turn % 2 == 0)))
        hist = rows.groupBy(*by, "__lo", "__hi", "__k").agg(
            F.count(F.lit(1)).alias("__c"), F.min(_V).alias("__mn"), F.max(_V).alias("__mx"))
        w = (Window.partitionBy(*by, "__lo", "__hi").orderBy("__k")
             .rowsBetween(Window.unboundedPreceding, -1))
        hist = hist.withColumn("__cb", F.coalesce(F.sum("__c").over(w), F.lit(0)))
        nxt = (act.join(hist, on=[*by, "__lo", "__hi"])
               .where((F.col("__rank") >= F.col("__below") + F.col("__cb"))
                      & (F.col("__rank") < F.col("__below") + F.col("__cb") + F.col("__c")))
               .select(*by, "__rank", F.col("__mn").alias("__lo"), F.col("__mx").alias("__hi"),
                       (F.col("__below") + F.col("__cb")).alias("__below"),
                       F.col("__c").alias("__cnt")))
        br, br_rows, small_br = _small_or_checkpoint(br.where(~is_open).unionByName(nxt), broadcast_rows)
        any_open = (any(r["__cnt"] > leaf_rows and r["__lo"] < r["__hi"] for r in br_rows)
                    if small_br else not br.where(is_open).isEmpty())

    single = br.where(F.col("__lo") == F.col("__hi")).select(*by, "__rank", F.col("__lo").alias("__val"))
    multi = br.where(F.col("__lo") < F.col("__hi"))
    mk = multi.select(*by, "__lo", "__hi").distinct()
    # every open bracket now holds <= leaf_rows values: a bounded sorted list
    lists = (base.join(side(mk), on=by)
             .where(F.col(_V).between(F.col("__lo"), F.col("__hi")))
             .groupBy(*by, "__lo", "__hi").agg(F.sort_array(F.collect_list(_V)).alias("__vals")))
    picked = (multi.join(lists, on=[*by, "__lo", "__hi"])
              .select(*by, "__rank", F.element_at("__vals", (F.col("__rank") - F.col("__below") + 1)
                                                  .cast("int")).alias("__val")))
    vals = single.unionByName(picked)
    v0 = vals.withColumnRenamed("__rank", "__r0").withColumnRenamed("__val", "__v0")
    v1 = vals.withColumnRenamed("__rank", "__r1").withColumnRenamed("__val", "__v1")
    return _interp_cols(tg.join(v0, on=[*by, "__r0"]).join(v1, on=[*by, "__r1"]), by)


def _interp_cols(df: DataFrame, by) -> DataFrame:
    return df.select(*by, F.col("__q").alias("prob"),
                     F.when((F.col("__frac") == 0) | (F.col("__v0") == F.col("__v1")), F.col("__v0"))
                     .otherwise(F.col("__v0") + (F.col("__v1") - F.col("__v0")) * F.col("__frac"))
                     .alias("quantile"))


def _all_small(base: DataFrame, by, tg: DataFrame) -> DataFrame:
    """Every group holds <= leaf_rows values (checked): one aggregate of
    bounded sorted lists answers all probabilities."""
    lists = base.groupBy(*by).agg(F.sort_array(F.collect_list(_V)).alias("__vals"))
    j = F.broadcast(tg).join(lists, on=by)
    j = j.withColumn("__v0", F.element_at("__vals", (F.col("__r0") + 1).cast("int"))) \
         .withColumn("__v1", F.element_at("__vals", (F.col("__r1") + 1).cast("int")))
    return _interp_cols(j, by)


def exact_quantiles(df: DataFrame, value, probs, by=(), buckets: int = 1024,
                    leaf_rows: int = 4096,
                    broadcast_rows: int = 50_000):
    """Exact interpolated quantiles of ``value`` (nulls ignored).

    Without ``by``: returns ``{prob: quantile}`` (a handful of numbers).
    With ``by``: returns a DataFrame ``(*by, prob, quantile)``; rows with a null
    group key are left out (as pandas ``groupby`` does)."""
    by = [by] if isinstance(by, str) else list(by)
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*by, v.cast("double").alias(_V)).where(F.col(_V).isNotNull() & ~F.isnan(_V))
    if not by:
        return _global(base, probs, buckets, leaf_rows)
    for b in by:
        base = base.where(F.col(b).isNotNull())
    return _grouped(base, by, probs, buckets, leaf_rows, broadcast_rows)


def medians(df: DataFrame, cols) -> dict:
    """Exact median of every column in ``cols`` (all-null column -> None).
    All columns share the same passes."""
    cols = list(cols)
    if not cols:
        return {}
    res = column_quantiles(df, cols, [0.5])
    return {c: res[c][0.5] for c in cols}


def column_quantiles(df: DataFrame, cols, probs, buckets: int = 1024, leaf_rows: int = 4096) -> dict:
    """``{column: {prob: quantile}}`` for many columns, sharing every pass."""
    return _columns(df, cols, probs, buckets, leaf_rows)
