"""Exact top-k inner-product search by distributed histogram selection.

For a block of queries, every task scores its candidates in batches and counts
the scores of each query in the bins of that query's open range.  The counts of
all tasks are added up; the bin that holds the k-th highest score is the next
range, until it is a single value.  Then all scores above that value pass, and
of those equal to it the smallest ids fill the places that are left.

Scores are made anew in each pass, so nothing of the size of queries times
candidates is ever kept.  A task sends, for a query, its bins from the top until
they hold k scores (lower ones can't hold the k-th), and in the end at most k of
the equal scores, so a vector that fills a third of the table sends no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valora.llm.common import cut, spread

_BATCH = 2048  # candidates scored at once
_QUERY_SLICE = 1024  # by so many queries


def usable(col: str):
    """No null vector, null component or component that isn't finite."""
    c = F.col(col)
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def quantize(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as float64 whole numbers."""
    return np.floor(scale * flat.astype(np.float64))


def inner(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products (queries x vectors) as int64.  Float products
    are exact while sums stay below 2**53, long ones below 2**63; beyond that
    Python's integers are used and results saturate."""
    if not queries.shape[1]:
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < 2.0 ** 53:
        return (queries @ vectors.T).astype(np.int64)
    if bound < 2.0 ** 62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    exact = np.array([[int(x) for x in r] for r in queries], object) @ np.array([[int(x) for x in r] for r in vectors], object).T
    return np.clip(exact, -(2 ** 63), 2 ** 63 - 1).astype(np.int64)


def _batches(it: Iterator[pa.RecordBatch], dim: int, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, nulls of the ids, quantized vectors)."""
    for batch in it:
        for i in range(0, batch.num_rows, _BATCH):
            part = batch.slice(i, _BATCH)
            ids, vectors = part.column(0), part.column(1)
            flat = np.asarray(vectors.flatten())
            yield (ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null()),
                   quantize(flat, scale).reshape(part.num_rows, dim))


def _scores(sent, ids: np.ndarray, nulls: np.ndarray, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first query, scores, true where a candidate is the query's own row)."""
    query_ids, queries = sent.value
    for at in range(0, len(queries), _QUERY_SLICE):
        own = (query_ids[at:at + _QUERY_SLICE, None] == ids[None, :]) & ~nulls
        yield at, inner(queries[at:at + _QUERY_SLICE], vectors), own


def _histogram(it, sent, state, bins: int, dim: int, scale: float) -> Iterator[pa.RecordBatch]:
    low, width, span, need = state.value
    counts = np.zeros((len(low), bins), np.int64)
    for ids, nulls, vectors in _batches(it, dim, scale):
        for at, scores, own in _scores(sent, ids, nulls, vectors):
            lo, w = low[at:at + len(scores), None], width[at:at + len(scores), None]
            where = (scores - lo) // w
            where[own | (scores < lo) | (scores - lo >= span[at:at + len(scores), None])] = -1
            q, c = np.nonzero(where >= 0)
            flat = q * bins + where[q, c]
            counts[at:at + len(scores)] += np.bincount(flat, minlength=len(scores) * bins).reshape(-1, bins)
    from_top = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
    q, b = np.nonzero((counts > 0) & (from_top < need[:, None]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(q.astype(np.int32)), pa.array(need[q]), pa.array(b.astype(np.int32)), pa.array(counts[q, b])],
        ["q", "need", "bin", "n"])


def _winners(it, sent, kth, k: int, dim: int, scale: float) -> Iterator[pa.RecordBatch]:
    limit, = kth.value
    tied: dict[int, list[int | None]] = {}
    for ids, nulls, vectors in _batches(it, dim, scale):
        for at, scores, own in _scores(sent, ids, nulls, vectors):
            lim = limit[at:at + len(scores), None]
            q, c = np.nonzero((scores > lim) & ~own)
            if len(q):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((q + at).astype(np.int32)), pa.array(ids[c], pa.int64(), mask=nulls[c]),
                     pa.array(scores[q, c])], ["q", "vec_id", "score"])
            q, c = np.nonzero((scores == lim) & ~own)
            # the k smallest ids of a query in this batch, then of the task
            order = np.lexsort((ids[c], nulls[c], q))
            q, c = q[order], c[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
            nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
            for x, v in zip((q[nth < k] + at).tolist(), c[nth < k].tolist(), strict=True):
                tied.setdefault(x, []).append(None if nulls[v] else int(ids[v]))
        for x, v in tied.items():
            if len(v) > k:
                tied[x] = sorted(v, key=lambda i: (i is None, i))[:k]
    rows = [(x, i, int(limit[x])) for x, v in tied.items() for i in sorted(v, key=lambda i: (i is None, i))[:k]]
    if rows:
        q, ids, scores = zip(*rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(q, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["q", "vec_id", "score"])


def _search_block(rows: DataFrame, query_ids: np.ndarray, queries: np.ndarray, most: float, k: int,
                  bins: int, dim: int, scale: float) -> DataFrame:
    """Top k of one block of queries over ``rows`` (id, vector)."""
    spark = rows.sparkSession
    sc = spark.sparkContext
    sent = sc.broadcast((query_ids, queries))
    reach = [min(2 ** 62, int(float(np.sqrt((q ** 2).sum())) * most * 1.0001) + 2) for q in queries]
    low = np.array([-r for r in reach], np.int64)
    span = np.array([2 * r - 1 for r in reach], np.int64)
    need = np.full(len(queries), k, np.int64)
    width = np.array([max(1, -(-s // bins)) for s in span], np.int64)
    found = np.ones(len(queries), bool)
    final = np.full(len(queries), -(2 ** 63), np.int64)  # fewer than k candidates: all pass
    open_ = np.ones(len(queries), bool)
    while open_.any():
        state = sc.broadcast((low, width, span, need))
        counts = rows.mapInArrow(lambda it, st=state: _histogram(it, sent, st, bins, dim, scale),
                                 "q int, need long, bin int, n long")
        total = counts.groupBy("q", "need", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        picked = (total.withColumn("upto", above).filter("upto >= need and upto - n < need")
                  .select("q", "bin", (F.col("upto") - F.col("n")).alias("over")).collect())
        found[:] = False
        for r in picked:  # one row a query of the block
            q = r["q"]
            found[q] = True
            low[q] += r["bin"] * width[q]
            need[q] -= r["over"]
        open_ &= found
        done = open_ & (width == 1)
        final[done] = low[done]
        open_ &= ~done
        span = width
        width = np.where(open_, np.maximum(1, -(-width // bins)), 1)
        # a query that is settled counts nothing more
        low[~open_] = 2 ** 62
    kth = sc.broadcast((final,))
    best = rows.mapInArrow(lambda it: _winners(it, sent, kth, k, dim, scale), "q int, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    names = spark.createDataFrame([(i, int(x)) for i, x in enumerate(query_ids)], "q int, query_id long")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .join(F.broadcast(names), "q").select("query_id", "rank", "vec_id", "score"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
          scale: float = 256.0, bins: int = 1024, block: int = 4096) -> DataFrame:
    """For each row of ``queries`` its ``k`` highest integer inner products with
    rows of ``vectors`` of another id: ``query_id``, ``rank``, ``vec_id``,
    ``score``; equal scores go by smaller id.

    Components are ``floor(scale * x)``.  Vectors that are null or hold a null or
    non-finite component take no part; queries of a null id neither; candidates
    of a null id do, behind all others of their score.  Vectors of different
    lengths have no product.  Repeated candidates have a place each; repeated
    queries have a result each.  Fewer than ``k`` candidates: all.  Empty tables
    give no rows.  Other columns aren't read.

    Queries go out in blocks of ``block`` rows, whatever their number; a pass
    reads all candidates once for a block.
    """
    spark = vectors.sparkSession
    pick = lambda df: df.filter(usable(f"`{vector_col}`")).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    rows = spread(pick(vectors))
    asked = cut(pick(queries).filter("id is not null")
                .withColumn("dim", F.size("v")).withColumn("at", F.monotonically_increasing_id()))
    out = None
    sizes = asked.groupBy("dim").count().collect()  # one row a vector length
    for dim, count in sorted((r["dim"], r["count"]) for r in sizes):
        same = rows.filter(F.size("v") == dim)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(F.floor(x * scale).cast("double"), 2.0))
        most = float(np.sqrt(same.agg(F.max(square)).first()[0] or 0.0))
        n_blocks = -(-count // block)
        for b in range(n_blocks):
            part = asked.filter((F.col("dim") == dim) & (F.pmod(F.xxhash64("id", "at"), F.lit(n_blocks)) == b))
            got = part.select("id", "v").orderBy("id", "v").collect()  # about ``block`` rows
            if not got:
                continue
            own = np.array([r["v"] for r in got], np.float64).reshape(len(got), dim)
            found = _search_block(same, np.array([r["id"] for r in got], np.int64), quantize(own, scale), most, k,
                                  bins, dim, scale)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out
