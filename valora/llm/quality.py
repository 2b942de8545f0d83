"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with calibrated probabilities.

1. Every token falls into one of ``buckets`` hashed words.  A bucket has a
   sparse random index vector; its word vector is the sum of the index vectors
   of its neighbours in all documents (one pass, added up in Spark), of unit
   length, then centred and scaled.
2. A document is the mean of its word vectors, the mean product of adjacent
   ones (repetition raises it), and the scaled length of the mean.
3. A tanh network in numpy is fitted on labelled documents (a bounded sample);
   a part of them held back from it sets the temperature of the logits.

Scores need the text alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import padded, spread, sum_arrays

_TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """A word between blanks to the hashed buckets (32-bit) of its tokens: runs
    of letters and digits, and runs of other marks.  Emptied at ``most`` words."""

    def __init__(self, buckets: int, most: int = 300_000):
        super().__init__()
        self._buckets, self._most = buckets, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
        out = self[word] = np.array(
            [zlib.crc32(t.encode("utf-8", "surrogatepass")) % self._buckets for t in _TOKEN.findall(word)],
            np.int32).tobytes()
        return out


def token_blocks(texts: Iterator[str | None], buckets: Buckets, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) arrays of about ``size`` tokens; a long text goes on in the
    next block."""
    rows: list[int] = []
    parts: list[np.ndarray] = []
    held = 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(rows, [len(p) for p in parts]), np.concatenate(parts).astype(np.int64)

    for row, text in enumerate(texts):
        for at in range(0, len(text or ""), 1 << 20):
            ids = np.frombuffer(b"".join(map(buckets.__getitem__, text[at:at + (1 << 20)].split())), np.int32)
            for i in range(0, len(ids), size):
                rows.append(row)
                parts.append(ids[i:i + size])
                held += len(parts[-1])
                if held >= size:
                    yield block()
                    rows, parts, held = [], [], 0
    if held:
        yield block()


def index_vectors(buckets: int, dim: int, nonzero: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero components of each index vector."""
    rng = np.random.default_rng(5)
    return rng.integers(0, dim, (buckets, nonzero)), rng.choice([-1.0, 1.0], (buckets, nonzero))


def word_vectors(docs: DataFrame, text_col: str, buckets: int, dim: int, window: int) -> np.ndarray:
    """Context vectors of all buckets over all of ``docs``, scaled.  The pass adds
    up neighbours' index vectors and bucket counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        places, signs = index_vectors(buckets, dim)
        known = Buckets(buckets)
        total = np.zeros(buckets * dim)
        seen = np.zeros(buckets)
        for batch in batches:
            for rows, ids in token_blocks((t.as_py() for t in batch.column(0)), known, 1 << 19):
                seen += np.bincount(ids, minlength=buckets)
                for step in range(1, window + 1):
                    near = rows[step:] == rows[:-step]
                    # pairs repeat: add each distinct one once, in both directions
                    pair, n = np.unique(ids[:-step][near] * buckets + ids[step:][near], return_counts=True)
                    a, b = pair // buckets, pair % buckets
                    for word, other in ((a, b), (b, a)):
                        for k in range(places.shape[1]):
                            total += np.bincount(word * dim + places[other, k], n * signs[other, k], buckets * dim)
        return {"sum": total, "n": seen}

    got = sum_arrays(spread(docs.select(F.col(f"`{text_col}`"))), count)
    vectors = padded(got, "sum", (buckets, dim))
    n = padded(got, "n", (buckets,))
    vectors /= np.sqrt((vectors ** 2).sum(axis=1, keepdims=True)) + 1e-9
    if n.sum():
        vectors -= (n[:, None] * vectors).sum(axis=0) / n.sum()
        vectors /= np.sqrt((n[:, None] * vectors ** 2).sum(axis=0) / n.sum()) + 1e-9
    return vectors.astype(np.float32)


def pooled(texts: Iterator[str | None], count: int, vectors: np.ndarray, known: Buckets) -> np.ndarray:
    """Document vectors: mean, mean adjacent product, length of the mean, and the
    log of the token count.  Texts without tokens are zero."""
    dim = vectors.shape[1]
    total = np.zeros((count, dim))
    product = np.zeros((count, dim))
    n = np.zeros(count)
    pairs = np.zeros(count)
    for rows, ids in token_blocks(texts, known, 1 << 16):
        words = vectors[ids]
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        total[rows[starts]] += np.add.reduceat(words, starts, axis=0)
        n += np.bincount(rows, minlength=count)
        near = rows[1:] == rows[:-1]
        if near.any():
            both = (words[1:] * words[:-1])[near]
            own = rows[1:][near]
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            product[own[starts]] += np.add.reduceat(both, starts, axis=0)
            pairs += np.bincount(own, minlength=count)
    mean = total / np.maximum(n, 1)[:, None]
    return np.concatenate([mean, product / np.maximum(pairs, 1)[:, None],
                           np.sqrt((mean ** 2).sum(axis=1, keepdims=True)), np.log1p(n)[:, None]], axis=1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Network:
    """Standardised input, one tanh layer, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 3) -> Network:
    """Adam on the log loss of 85 % of the rows; the rest sets the temperature.
    Without rows, or with one class only, scores are the smoothed share of ones."""
    share = (y.sum() + 1) / (len(y) + 2)
    dim = x.shape[1]
    net = Network(np.zeros(dim), np.ones(dim), np.zeros((dim, hidden)), np.zeros(hidden), np.zeros(hidden),
                  float(np.log(share / (1 - share))))
    if len(y) < 20 or y.min() == y.max():
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[:len(y) * 15 // 100], order[len(y) * 15 // 100:]
    net.mean, net.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-6
    net.w1, net.w2 = rng.normal(0, dim ** -0.5, (dim, hidden)), rng.normal(0, hidden ** -0.5, hidden)
    z = (x[fit] - net.mean) / net.scale
    t = y[fit]
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs)
        by = rng.permutation(len(t))
        for i in range(0, len(t), 128):
            b = by[i:i + 128]
            h = np.tanh(z[b] @ params[0] + params[1])
            d = (_sigmoid(h @ params[2] + params[3]) - t[b]) / len(b)
            back = np.outer(d, params[2]) * (1 - h * h)
            grads = [z[b].T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits = net.logits(x[held])
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.logaddexp(0, np.where(y[held] == 1, -1, 1) * logits / g).mean() for g in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", buckets: int = 1 << 15, dim: int = 32, window: int = 2,
          sample_rows: int = 20_000) -> QualityModel:
    """Word vectors over all ``docs``; the network on the labelled rows.

    Of these, at most about ``sample_rows`` are taken, by a hash of the id (the
    stated bound of the fit, and so of what is broadcast to find their texts; word
    vectors are never sampled).  Rows of a null
    label or id don't train; an id with several labels trains with each.
    """
    vectors = word_vectors(docs, text_col, buckets, dim, window)
    given = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna()
    n = given.count()
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    given = given.filter(mark < F.lit(int((1 << 20) * min(1.0, sample_rows / max(n, 1))) + 1))
    wanted = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            x = pooled((t.as_py() for t in batch.column(0)), batch.num_rows, sent.value, known).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).cast(pa.int32())], ["x", "y"])

    got = wanted.join(F.broadcast(given), "id").select("text", "y").mapInArrow(rows, "x binary, y int").collect()
    got.sort(key=lambda r: (bytes(r["x"]), r["y"]))
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], np.float64).reshape(len(got), 2 * dim + 2)
    return QualityModel(vectors, fit_network(x, np.array([float(r["y"]) for r in got])))


def score_udf(model: QualityModel, spark):
    """Column function: text to its probability of label 1."""
    sent = spark.sparkContext.broadcast(model)
    known = Buckets(len(model.vectors))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for i in range(0, len(texts), 1024):
            part = texts.slice(i, 1024)
            x = pooled((t.as_py() for t in part), len(part), sent.value.vectors, known)
            out.append(sent.value.network.scores(x))
        return pa.array(np.concatenate(out) if out else np.zeros(0))
    return score


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of each row.  Null and blank texts have the score
    of a text without tokens; repeated rows keep one row each; a null id stays
    null; other columns aren't read; an empty table gives no rows."""
    score = score_udf(model, docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`"), score(F.col(f"`{text_col}`")).alias("score"))


def keep_good(docs: DataFrame, model: QualityModel, threshold: float, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that score below ``threshold``."""
    score = score_udf(model, docs.sparkSession)
    return docs.filter(score(F.col(f"`{text_col}`")) >= threshold)
