"""Masked pseudo-likelihood by a bidirectional window network in numpy.

The network predicts a token from ``window`` tokens on each side: a table for
each relative place turns a neighbour into a vector, their sum goes through
tanh, and a two-level softmax (class, then member of the class) gives the
token's probability.  A document's score is the sum of its tokens' conditional
log-probabilities, each token masked in turn.

Words are counted over all documents, and the counts are a table of the shared
folder.  The most frequent words have a number of the network each, the others share
numbers by their last bytes, which tell most of a word's kind: a rare word's
probability is that of its number in its context times its share of the counts of all
words with that number.  The ``head`` most frequent words' counts are in every task;
only the words beyond them are joined with the table of counts, and words that the
corpus doesn't hold count as one.

The documents are numbered once: 16-bit numbers in pieces of bounded length, dealt to
the rounds by hashes of (id, text, piece).  Each round sums the gradient of its pieces
over all tasks, and the driver takes one Adam step.  So every token is a target, each
round reads its own files, and the network depends on the documents but not on how they
lie in partitions (beyond the rounding of sums).  Counts and gradients gathered thus
grow with the corpus; the network doesn't.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valora.llm.common import raw, scratch_path, spread, word_chunks


@dataclass(frozen=True)
class Shape:
    classes: int = 32
    members: int = 32
    hashed: int = 512  # numbers that rare words share
    window: int = 2
    hidden: int = 16
    ending: int = 3  # bytes of a rare word that choose its number

    @property
    def tokens(self) -> int:
        return self.classes * self.members

    @property
    def places(self) -> int:
        return 2 * self.window


class Numbers(dict):
    """Word to number: its rank if frequent, else one shared by words of its ending."""

    def __init__(self, frequent: list[bytes], shape: Shape):
        self._shape = shape
        super().__init__((w, i) for i, w in enumerate(frequent))

    def __missing__(self, word: bytes) -> int:
        s = self._shape
        return s.tokens - s.hashed + zlib.crc32(word[-s.ending:]) % s.hashed


@dataclass
class Vocabulary:
    shape: Shape
    head: list[bytes]  # the most frequent words, those with numbers of their own first
    counts: list[int]  # of the head
    rare: list[int]  # counts of rare words by hashed number
    words: str  # path of the counts (word, n)

    @property
    def frequent(self) -> list[bytes]:
        return self.head[:self.shape.tokens - self.shape.hashed]

    @property
    def total(self) -> int:
        return sum(self.counts[:len(self.frequent)]) + sum(self.rare)

    def by_number(self) -> np.ndarray:
        """How often each number occurs."""
        own = self.counts[:len(self.frequent)]
        return np.array(own + [0] * (self.shape.tokens - self.shape.hashed - len(own)) + self.rare, np.float64)


@dataclass
class Network:
    shape: Shape
    tables: np.ndarray  # places x (tokens + 1) x hidden; the last row is the outside
    bias: np.ndarray
    top: np.ndarray  # hidden x classes
    top_bias: np.ndarray
    low: np.ndarray  # classes x hidden x members
    low_bias: np.ndarray
    frequent: list[bytes] = field(default_factory=list)
    vocabulary: Vocabulary | None = None

    @classmethod
    def start(cls, shape: Shape, frequent: list[bytes]) -> Network:
        rng = np.random.default_rng(1)
        r = lambda *d: rng.normal(0, 0.1, d).astype(np.float32)
        z = lambda *d: np.zeros(d, np.float32)
        s = shape
        return cls(s, r(s.places, s.tokens + 1, s.hidden), z(s.hidden), r(s.hidden, s.classes), z(s.classes),
                   r(s.classes, s.hidden, s.members), z(s.classes, s.members), frequent)

    @classmethod
    def of_counts(cls, vocabulary: Vocabulary) -> Network:
        """A start whose biases are the numbers' frequencies."""
        s = vocabulary.shape
        net = cls.start(s, vocabulary.frequent)
        p = (vocabulary.by_number() + 0.5).reshape(s.classes, s.members)
        by_class = p.sum(axis=1, keepdims=True)
        net.top_bias = np.log(by_class[:, 0] / p.sum()).astype(np.float32)
        net.low_bias = np.log(p / by_class).astype(np.float32)
        net.vocabulary = vocabulary
        return net

    @property
    def rare(self) -> list[int]:
        return self.vocabulary.rare if self.vocabulary else []

    def arrays(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in ("tables", "bias", "top", "top_bias", "low", "low_bias")}

    def hidden(self, near: np.ndarray) -> np.ndarray:
        h = self.tables[0][near[:, 0]]
        for k in range(1, self.shape.places):
            h += self.tables[k][near[:, k]]
        h += self.bias
        return np.tanh(h, out=h)

    def log_prob(self, near: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | neighbours) of each row."""
        order, ends = self._by_class(target)
        h = self.hidden(near[order])
        group, member = np.divmod(target[order].astype(np.int64), self.shape.members)
        rows = np.arange(len(h))
        sorted_out = _log_prob_at(h @ self.top + self.top_bias, rows, group)
        for c in range(self.shape.classes):
            at = slice(ends[c], ends[c + 1])
            if ends[c] < ends[c + 1]:
                sorted_out[at] += _log_prob_at(h[at] @ self.low[c] + self.low_bias[c], rows[:ends[c + 1] - ends[c]], member[at])
        out = np.empty(len(h))
        out[order] = sorted_out
        return out

    def gradients(self, near: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability."""
        g = {n: np.zeros(a.shape) for n, a in self.arrays().items()}
        self.add_gradients(near, target, g)
        return {n: a / len(target) for n, a in g.items()}

    def add_gradients(self, near: np.ndarray, target: np.ndarray, g: dict[str, np.ndarray]) -> None:
        """Adds those of the summed negative log-probability to ``g``."""
        order, ends = self._by_class(target)
        near = near[order]
        h = self.hidden(near)
        group, member = np.divmod(target[order].astype(np.int64), self.shape.members)
        rows = np.arange(len(h))
        d = _softmax(h @ self.top + self.top_bias)
        d[rows, group] -= 1
        g["top"] += h.T @ d
        g["top_bias"] += d.sum(axis=0, dtype=np.float64)
        back = d @ self.top.T
        for c in range(self.shape.classes):
            if ends[c] < ends[c + 1]:
                at = slice(ends[c], ends[c + 1])
                e = _softmax(h[at] @ self.low[c] + self.low_bias[c])
                e[rows[:len(e)], member[at]] -= 1
                g["low"][c] += h[at].T @ e
                g["low_bias"][c] += e.sum(axis=0, dtype=np.float64)
                back[at] += e @ self.low[c].T
        back *= 1 - h * h
        g["bias"] += back.sum(axis=0, dtype=np.float64)
        for k in range(self.shape.places):
            # sums by number: sorted runs, much faster than np.add.at
            order = np.argsort(near[:, k], kind="stable")
            ids = near[order, k]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            g["tables"][k][ids[first]] += np.add.reduceat(back[order], first, axis=0)

    def _by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(target, kind="stable")
        return order, np.searchsorted(target[order], np.arange(self.shape.classes + 1) * self.shape.members)


def _log_prob_at(x: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    own = x[rows, at].astype(np.float64)
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def count_words(docs: DataFrame, text_col: str) -> str:
    """The path of a table of all words of all documents: ``word``, ``n``."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                              ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for words in word_chunks((text.as_py() or b"").lower(), 0):
                    seen.update(words)
                if len(seen) > 400_000:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    counted = spread(docs.select(raw(text_col).alias("t"))).mapInArrow(tally, "word binary, n long")
    path = scratch_path(docs.sparkSession, "lm-words")
    counted.groupBy("word").agg(F.sum("n").alias("n")).write.parquet(path)
    return path


def vocabulary(spark: SparkSession, path: str, shape: Shape, head: int) -> Vocabulary:
    """The most frequent words with their counts, at most ``head`` or as many as have
    numbers of their own (ties by the word), and how often the other words occur by
    hashed number."""
    counts = spark.read.parquet(path)
    own = shape.tokens - shape.hashed
    # levels of counts, fewer than 2,048: the head is all words of the highest levels that fit
    # in it whole, so what the driver gets is the head and not one of every partition
    counts = counts.withColumn("level", F.floor(F.log2("n") * 32))
    kept, least = 0, None
    for r in sorted(counts.groupBy("level").count().collect(), key=lambda r: -r["level"]):
        if kept + r["count"] > head:
            break
        kept, least = kept + r["count"], r["level"]
    above = F.lit(False) if least is None else F.col("level") >= least
    best = sorted(counts.filter(above).select("word", "n").collect(), key=lambda r: (-r["n"], bytes(r["word"])))
    if kept < own:
        best += counts.filter(~above).orderBy(F.desc("n"), "word").limit(own - kept).collect()
    number = F.crc32(F.substring("word", -shape.ending, shape.ending)) % shape.hashed
    rare = [0] * shape.hashed
    for r in counts.groupBy(number.alias("at")).agg(F.sum("n").alias("n")).collect():
        rare[r["at"]] = r["n"]
    for r in best[:own]:  # few: their counts are taken off the sums
        rare[zlib.crc32(bytes(r["word"])[-shape.ending:]) % shape.hashed] -= r["n"]
    return Vocabulary(shape, [bytes(r["word"]) for r in best], [r["n"] for r in best], rare, path)


def pieces(text: bytes | None, head: dict[bytes, int], of_head: np.ndarray, numbers: Numbers, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """A text in pieces of at most ``size`` tokens: numbers with ``window`` neighbours on
    each side (beyond the text: the outside), places in the head (-1: not there), and the
    words not in the head.  ``of_head``: the head's numbers, and one more entry.  Words are those between ASCII blanks, A-Z lowered.  A text
    without words is one piece without tokens."""
    w, outside = numbers._shape.window, numbers._shape.tokens
    ids, places, strange = [np.full(w, outside, np.uint16)], [], []
    for words in word_chunks(text.lower(), 0) if text else ():
        at = np.fromiter(map(head.get, words, repeat(-1)), np.int64, len(words))
        beyond = np.flatnonzero(at < 0).tolist()
        own = of_head[at]
        own[beyond] = [numbers[words[i]] for i in beyond]
        ids.append(own)
        places.append(at)
        strange += [words[i] for i in beyond]
    whole = np.concatenate([*ids, np.full(w, outside, np.uint16)])
    places = np.concatenate(places) if places else np.zeros(0, np.int64)
    begun = 0
    for at in range(0, max(1, len(places)), size):
        part = places[at:at + size]
        n = int((part < 0).sum())
        yield whole[at:at + len(part) + 2 * w], part, strange[begun:begun + n]
        begun += n


def round_of(texts: np.ndarray, places: np.ndarray, rounds: int) -> np.ndarray:
    """The round of each (text hash, piece)."""
    h = texts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + places.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) % np.uint64(rounds)).astype(np.int64)


def number_documents(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str, rounds: int = 1,
                     piece: int = 1 << 16) -> str:
    """The path of the numbered documents, a row for each piece: ``row`` and ``id`` of the
    document, ``n`` tokens, ``ids`` (16 bits each, with the neighbours), ``share`` (sum of
    the logarithms of the rare words' shares, those beyond the head as if they occurred
    once), ``strange`` (the words beyond the head); one folder a round (``turn``), in
    several files."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocab)
    files = max(spark.sparkContext.defaultParallelism, math.ceil(vocab.total / (rounds << 25)))
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("turn", T.IntegerType()),
                           T.StructField("file", T.IntegerType()), T.StructField("n", T.LongType()),
                           T.StructField("ids", T.BinaryType()), T.StructField("share", T.DoubleType()),
                           T.StructField("strange", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        shape = v.shape
        numbers = Numbers(v.frequent, shape)
        head = {w: i for i, w in enumerate(v.head)}
        of_head = np.array([numbers[w] for w in v.head] + [0], np.uint16)
        total = np.log(np.array(v.rare, np.float64) + 1)  # one more for all words that the corpus doesn't hold
        first = shape.tokens - shape.hashed
        known = np.append(np.log(np.array(v.counts, np.float64)), 0.0)  # the last: words beyond the head
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("from", "piece", "n", "ids", "share", "strange")}
                for i, text in enumerate(part.column("text")):
                    for j, (ids, places, strange) in enumerate(pieces(text.as_py(), head, of_head, numbers, piece)):
                        own = ids[shape.window:len(ids) - shape.window]
                        rare = own >= first
                        share = float((known[places[rare]] - total[own[rare] - first]).sum())
                        for k, x in zip(out, (i, j, len(places), ids.tobytes(), share, b" ".join(strange)), strict=True):
                            out[k].append(x)
                come = pa.array(out["from"], pa.int64())
                turn = round_of(part.column("key").take(come).to_numpy().view(np.uint64), np.array(out["piece"]), rounds)
                row = part.column("row").take(come)
                file = (row.to_numpy() + np.array(out["piece"])) % files
                yield pa.RecordBatch.from_arrays(
                    [row, part.column("id").take(come), pa.array(turn, pa.int32()), pa.array(file, pa.int32()),
                     pa.array(out["n"], pa.int64()), pa.array(out["ids"], pa.binary()), pa.array(out["share"], pa.float64()),
                     pa.array(out["strange"], pa.binary())], names=schema.names)

    found = spread(docs.select(F.col(f"`{id_col}`").alias("id"), raw(text_col).alias("text"))).select(
        F.monotonically_increasing_id().alias("row"), "id", F.xxhash64("id", "text").alias("key"), "text")
    path = scratch_path(spark, "lm-numbered")
    (found.mapInArrow(run, schema).repartition(files * rounds, "turn", "file").drop("file")
     .write.partitionBy("turn").parquet(path))
    return path


def read_numbered(spark: SparkSession, path: str, id_type: T.DataType) -> DataFrame:
    """The table of :func:`number_documents`."""
    return spark.read.schema(T.StructType([
        T.StructField("row", T.LongType()), T.StructField("id", id_type), T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("share", T.DoubleType()),
        T.StructField("strange", T.BinaryType()), T.StructField("turn", T.IntegerType())])).parquet(path)


def token_blocks(ids: pa.Array, window: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(piece, token, neighbours) of the tokens of pieces, ``size`` at a time."""
    parts = [np.frombuffer(x.as_buffer(), np.uint16) for x in ids]
    if not parts:
        return
    flat = np.concatenate(parts)
    lengths = np.array([len(p) - 2 * window for p in parts])
    of = np.repeat(np.arange(len(parts)), lengths)
    place = np.arange(len(of)) + (2 * of + 1) * window
    steps = np.array([k for k in range(-window, window + 1) if k])
    for at in range(0, len(of), size):
        here = place[at:at + size]
        yield of[at:at + size], flat[here], flat[here[:, None] + steps]


def sum_vectors(df: DataFrame, task, size: int, block: int = 1 << 14) -> np.ndarray:
    """The sum over the partitions of ``task``'s vectors of ``size`` numbers, added up
    in Spark by blocks of ``block`` numbers."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vector = task(batches)
        if vector.any():
            at = list(range(0, size, block))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([vector[b:b + block].tobytes() for b in at])],
                                             ["at", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(part.as_buffer(), np.float64)
                have[at] = have[at] + x if at in have else x
        for at, x in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([x.tobytes()])], ["at", "part"])

    tasks = min(math.ceil(size / block), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = np.zeros(size)
    for r in df.mapInArrow(emit, "at long, part binary").repartition(tasks, "at").mapInArrow(add, "at long, part binary").collect():
        x = np.frombuffer(r["part"], np.float64)
        out[r["at"]:r["at"] + len(x)] = x
    return out


def fit(numbered: DataFrame, vocab: Vocabulary, rounds: int, masked: float = 0.0, batch: int = 1 << 14,
        rate: float = 0.15) -> Network:
    """The network after a step a round.  A round's targets are the pieces dealt to it,
    or a share ``masked`` of all if that is more: every token is one equally often."""
    net = Network.of_counts(vocab)
    shape = vocab.shape
    sc = numbered.sparkSession.sparkContext
    flat = {n: a.size for n, a in net.arrays().items()}
    mean, square = ({n: np.zeros(a.shape) for n, a in net.arrays().items()} for _ in range(2))
    times = min(rounds, max(1, round(masked * rounds)))
    for turn in range(rounds if vocab.total else 0):
        sent = sc.broadcast(net.arrays())

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> np.ndarray:
            own = Network(shape, **sent.value)
            sums = {n: np.zeros(a.shape) for n, a in own.arrays().items()}
            seen = 0
            for b in batches:
                for _, target, near in token_blocks(b.column(0), shape.window, batch):
                    own.add_gradients(near, target, sums)
                    seen += len(target)
            return np.concatenate([*(a.ravel() for a in sums.values()), [float(seen)]])

        part = numbered.filter(F.col("turn").isin([(turn + k) % rounds for k in range(times)])).select("ids")
        got = sum_vectors(part, task, sum(flat.values()) + 1)
        sent.destroy()
        if not got[-1]:  # no piece was dealt to this round
            continue
        step = rate * min(1.0, 2 * (rounds - turn) / rounds)
        at = 0
        for n, a in net.arrays().items():
            g = got[at:at + flat[n]].reshape(a.shape) / got[-1]
            at += flat[n]
            mean[n] = 0.8 * mean[n] + 0.2 * g
            square[n] = 0.95 * square[n] + 0.05 * g * g
            size = np.sqrt(square[n] / (1 - 0.95 ** (turn + 1))) + _LEAST
            setattr(net, n, (a - step * mean[n] / (1 - 0.8 ** (turn + 1)) / size).astype(np.float32))
    return net


_LEAST = 1e-6  # well above the rounding of summed gradients, so that the order of sums doesn't steer a step


def train(docs: DataFrame, text_col: str = "text", shape: Shape = Shape(), rounds: int = 24, masked: float = 0.0,
          batch: int = 1 << 14, rate: float = 0.15, id_col: str = "doc_id", head: int = 100_000) -> Network:
    """The network of all documents (see :func:`fit`).  ``head`` words' counts are sent to
    all tasks.  Without words it stays as it began."""
    vocab = vocabulary(docs.sparkSession, count_words(docs, text_col), shape, head)
    path = number_documents(docs, vocab, id_col, text_col, rounds)
    return fit(read_numbered(docs.sparkSession, path, docs.schema[id_col].dataType), vocab, rounds, masked, batch, rate)


def score_udf(net: Network, spark: SparkSession, batch: int = 1 << 14):
    """Column function: a piece's ids to the sum of its tokens' log-probabilities."""
    sent = spark.sparkContext.broadcast(net.arrays())
    shape = net.shape

    @F.arrow_udf("double")
    def score(ids: pa.Array) -> pa.Array:
        own = Network(shape, **sent.value)
        total = np.zeros(len(ids))
        for piece, target, near in token_blocks(ids, shape.window, batch):
            total += np.bincount(piece, own.log_prob(near, target), len(ids))
        return pa.array(total)
    return score


def _strange_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            lists = pc.split_pattern(part.column(1), b" ")
            yield pa.RecordBatch.from_arrays([part.column(0).take(pc.list_parent_indices(lists)), pc.list_flatten(lists)],
                                             ["row", "word"])


def score_numbered(numbered: DataFrame, net: Network, id_col: str = "doc_id") -> DataFrame:
    """The scores of numbered documents; see :func:`score_documents`."""
    spark = numbered.sparkSession
    found = numbered.select("row", "id", "n", (score_udf(net, spark)("ids") + F.col("share")).alias("p"))
    # of the words beyond the head those with a count above one are left to look up
    strange = numbered.filter(F.length("strange") > 0).select("row", "strange").mapInArrow(_strange_words, "row long, word binary")
    often = spark.read.parquet(net.vocabulary.words).filter("n > 1")
    more = strange.join(often, "word").groupBy("row").agg(F.sum(F.log("n")).alias("p"))
    none = F.lit(None).cast(numbered.schema["id"].dataType)
    out = found.unionByName(more.select("row", none.alias("id"), F.lit(0).cast("long").alias("n"), "p")).groupBy("row").agg(
        F.first("id", ignorenulls=True).alias("id"), F.sum("n").alias("n_tokens"), F.sum("p").alias("log_prob"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_prob",
                      F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_tokens``, ``log_prob`` (sum over the text's tokens) and
    ``mean_log_prob``.  Null and blank texts: 0 tokens, sum 0, mean null.  Repeated
    rows keep one row each; a null id stays null; other columns aren't read; an
    empty table gives no rows."""
    path = number_documents(docs, net.vocabulary, id_col, text_col)
    return score_numbered(read_numbered(docs.sparkSession, path, docs.schema[id_col].dataType), net, id_col)


def train_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shape: Shape = Shape(),
                    rounds: int = 24, head: int = 100_000) -> DataFrame:
    """:func:`train` and :func:`score_documents` of the same documents, numbered once."""
    spark = docs.sparkSession
    vocab = vocabulary(spark, count_words(docs, text_col), shape, head)
    numbered = read_numbered(spark, number_documents(docs, vocab, id_col, text_col, rounds), docs.schema[id_col].dataType)
    return score_numbered(numbered, fit(numbered, vocab, rounds), id_col)
