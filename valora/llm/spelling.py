"""Spelling variants: words at one edit, by blocked Gram matrices.

Words are counted over all documents.  A word is the vector of its letter
counts; the squared distance of two vectors is ``|x|^2 + |y|^2 - 2xy``, so one
matrix product gives it for two blocks of words.  A replaced letter moves it to
two, an inserted or deleted one to one, so pairs at most two in blocks of the
same or the next length are kept and their edit verified letter by letter.

Blocks are lengths, parted further by the counts of a few groups of letters: an
edit moves at most one count up and one down, so a block only meets the blocks
whose counts differ that little.  The number of groups grows with the vocabulary
and changes the work, never the result.  A block of more than ``part_words``
words is kept as several matrices, and each of a neighbour's matrices is a join
key of its own, so no task gathers a large block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import cut, raw, spread

_RUN = re.compile("[a-zÀ-ÿ]+")
#: A key is the length, then a digit for the count of each group but the last,
#: modulo 16: what wraps around is only compared in vain.
_LENGTH_SHIFT, _DIGIT_BITS, MOST_GROUPS = 32, 4, 9
MATRIX_BYTES = 1 << 20


# ------------------------------------------------------------------ counting
def doc_words(doc_id: str, text: bytes, every: int, least: int) -> Counter:
    """Words of at least ``least`` code points of one text with their counts.  A
    run whose crc32 with the id divides by ``every`` loses the code point at crc32
    modulo its length."""
    out: Counter = Counter()
    start = zlib.crc32(f"{doc_id}:".encode())
    # runs lower-cased in A-Z only; no run below ``least`` can become a word
    plain = text.lower().decode(errors="replace")
    runs = Counter(_RUN.findall(plain) if len(plain) < 1 << 24 else (m[0] for m in _RUN.finditer(plain)))
    for word, n in runs.items():
        if len(word) < least:
            continue
        if every:
            crc = zlib.crc32(word.encode(), start)
            if crc % every == 0:
                at = crc % len(word)
                word = word[:at] + word[at + 1:]
                if len(word) < least:
                    continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str, text_col: str, every: int, least: int, times: int,
               held: int = 300_000) -> DataFrame:
    """(word, n) of the words that occur ``times`` times or more.  A task sends on
    the counts of at most ``held`` words at a time."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(have.keys(), pa.string()), pa.array(have.values(), pa.int64())], ["word", "n"])
            have.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                data = text.as_py()
                if data:
                    have.update(doc_words(doc_id.as_py() or "", data, every, least))
                    if len(have) > held:
                        yield out()
        if have:
            yield out()

    rows = spread(docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), raw(text_col).alias("text")))
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= times))


# -------------------------------------------------------------------- blocks
def groups_for(count: int) -> int:
    """Groups of letters for ``count`` words."""
    groups = 2
    while groups < MOST_GROUPS and count >> (11 + 2 * groups):
        groups += 1
    return groups


def letter_groups(groups: int) -> np.ndarray:
    """Group of each Latin-1 code: letters by frequency are dealt to and fro."""
    out = np.arange(256) % groups
    for i, c in enumerate("etaoinshrdlucmfwypvbgkjqxz"):
        turn, at = divmod(i, groups)
        out[ord(c)] = at if turn % 2 == 0 else groups - 1 - at
    return out


def neighbours(groups: int) -> list[tuple[int, ...]]:
    """(length step, steps of the keyed groups) to each block that one edit
    reaches: same length first (one of each pair of opposite steps), then the
    next length."""
    keyed = groups - 1  # the last group follows from the others and the length
    unit = [tuple(int(i == g) for i in range(keyed)) for g in range(groups)]
    same = {tuple(a - b for a, b in zip(x, y, strict=True)) for x in unit for y in unit}
    return [(0, *s) for s in sorted(same) if s >= (0,) * keyed] + [(1, *u) for u in unit]


def _digit_at(g: int) -> int:
    return _DIGIT_BITS * g


def _step_key(step: tuple[int, ...]):
    """Column: the key ``step`` away from the column ``key``."""
    out = (F.shiftright("key", _LENGTH_SHIFT) + step[0]) * (1 << _LENGTH_SHIFT)
    for g, d in enumerate(step[1:]):
        digit = F.shiftright("key", _digit_at(g)) + d
        out = out + digit.bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1)) * (1 << _digit_at(g))
    return out


def _keyed(words: DataFrame, groups: int) -> DataFrame:
    """(word, n, key)."""
    table = letter_groups(groups)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(0).to_pylist()
            codes = [np.frombuffer(w.encode("latin-1"), np.uint8) for w in text]
            lengths = np.array([len(c) for c in codes], np.int64)
            row = np.repeat(np.arange(len(codes)), lengths)
            flat = table[np.concatenate(codes)] if len(codes) else np.zeros(0, np.int64)
            counts = np.bincount(row * groups + flat, minlength=len(codes) * groups).reshape(len(codes), groups)
            key = lengths << _LENGTH_SHIFT
            for g in range(groups - 1):
                key += (counts[:, g] % (1 << _DIGIT_BITS)) << _digit_at(g)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key)], ["word", "n", "key"])

    return words.select("word", "n").mapInArrow(keys, "word string, n long, key long")


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, part, word, n) sorted by key and part to one row a matrix: its
    words as bytes, all of one length, and their counts."""
    held: tuple[int, int] | None = None
    words: list[str] = []
    counts: list[int] = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([held[0]]), pa.array([held[1]], pa.int32()), pa.array(["".join(words).encode("latin-1")]),
             pa.array([np.array(counts, np.int64).tobytes()])], ["key", "part", "words", "counts"])

    for batch in batches:
        for key, part, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, part) != held:
                if words:
                    yield out()
                held, words, counts = (key, part), [], []
            words.append(word)
            counts.append(n)
    if words:
        yield out()


# --------------------------------------------------------------------- pairs
def near_pairs(a: np.ndarray, b: np.ndarray, same: bool, cells: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of two word matrices (words x length, ``b`` of the same or the
    next length) that differ by exactly one edit; ``same``: both are one matrix,
    then i < j."""
    # letters that occur: a column of counts for each
    letters = np.flatnonzero(np.bincount(np.concatenate([a.ravel(), b.ravel()]), minlength=256))
    place = np.zeros(256, np.int64)
    place[letters] = np.arange(len(letters))
    exact = np.float32 if max(a.shape[1], b.shape[1]) < 2048 else np.float64  # squares stay whole numbers

    def letter_counts(m: np.ndarray) -> np.ndarray:
        cell = place[m] + np.arange(len(m))[:, None] * len(letters)
        return np.bincount(cell.ravel(), minlength=len(m) * len(letters)).reshape(len(m), -1).astype(exact)

    x, y = letter_counts(a), letter_counts(b)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left = np.concatenate([-2 * x, xx[:, None], np.ones_like(xx)[:, None]], axis=1)
    right = np.concatenate([y, np.ones_like(yy)[:, None], yy[:, None]], axis=1).T
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, cells // max(1, len(b)))
    for at in range(0, len(a), step):
        i, j = np.divmod(np.flatnonzero(left[at:at + step] @ right < 2.5), len(b))
        i += at
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        verify = max(1, cells // a.shape[1])
        for k in range(0, len(i), verify):
            p, q = i[k:k + verify], j[k:k + verify]
            good = one_edit(a[p], b[q])
            found.append((p[good], q[good]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row: ``b`` is ``a`` with exactly one letter replaced or, one longer,
    inserted."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(1) == 1
    ahead = np.cumprod(a == b[:, :n], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    behind = np.cumprod((a == b[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(1, dtype=np.int64)
    return ahead + behind >= n


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of matrices to links in both directions: (word, near, near_n)."""
    def matrix(words: pa.Scalar, n: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        counts = np.frombuffer(n.as_buffer(), np.int64)
        return np.frombuffer(words.as_buffer(), np.uint8).reshape(len(counts), -1), counts

    def texts(m: np.ndarray) -> pa.Array:
        data = m.tobytes().decode("latin-1")
        n = m.shape[1]
        return pa.array([data[i:i + n] for i in range(0, len(data), n)], pa.string())

    for batch in batches:
        for words_a, counts_a, words_b, counts_b, same in zip(*batch.columns, strict=True):
            (a, an), (b, bn) = matrix(words_a, counts_a), matrix(words_b, counts_b)
            i, j = near_pairs(a, b, same.as_py())
            if len(i):
                x, y = texts(a[i]), texts(b[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([x, y]), pa.concat_arrays([y, x]), pa.array(np.concatenate([bn[j], an[i]]))],
                    ["word", "near", "near_n"])


def near_words(words: DataFrame, part_words: int = 512, groups: int | None = None) -> DataFrame:
    """``words`` (word string of Latin-1 letters, no repeats; n long) to all links
    (word, near, near_n) between words at exactly one inserted, deleted or replaced
    code point, each in both directions.  An empty table gives no links."""
    spark = words.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if groups is None:
        groups = groups_for(words.count())
    keyed = cut(_keyed(words, groups))
    length = F.shiftright("key", _LENGTH_SHIFT)
    # very long words: fewer to a matrix
    parts = F.greatest(F.ceil(F.col("m") / part_words), F.ceil(F.col("m") * length / MATRIX_BYTES)).cast("int")
    sizes = cut(keyed.groupBy("key").agg(F.count("*").alias("m")).select("key", parts.alias("parts")))
    rows = (keyed.join(sizes, "key")
            .select("key", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int").alias("part"), "word", "n"))
    blocks = cut(rows.repartition(shuffles, "key", "part").sortWithinPartitions("key", "part")
                 .mapInArrow(_matrices, "key long, part int, words binary, counts binary"))
    steps = F.explode(F.array(*(_step_key(s) for s in neighbours(groups))))
    other = sizes.select(F.col("key").alias("to"), "parts")
    mine = (blocks.select(F.col("key").alias("from"), F.col("part").alias("part_a"), F.col("words").alias("words_a"),
                          F.col("counts").alias("counts_a"), "key")
            .withColumn("to", steps).drop("key").join(other, "to")
            .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            .filter("`from` <> `to` OR part_a <= part").drop("parts"))
    same = (F.col("from") == F.col("to")) & (F.col("part_a") == F.col("part"))
    theirs = blocks.select(F.col("key").alias("to"), "part", F.col("words").alias("words_b"), F.col("counts").alias("counts_b"))
    met = mine.join(theirs, ["to", "part"]).select("words_a", "counts_a", "words_b", "counts_b", same.alias("same"))
    return met.mapInArrow(_pairs, "word string, near string, near_n long")


# ------------------------------------------------------------------- variants
def follow(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): from each word along the forms to the last.
    Every round doubles the steps that are known; a form occurs more often than
    its word, so no row of forms comes round."""
    state = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not state.join(onward, "root", "left_semi").limit(1).count():
            return state
        state = cut(state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least: int = 6,
             times: int = 5, ratio: int = 5, part_words: int = 512) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the maximal runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z
    only, less a code point where the run's crc32 with the id divides by ``every``
    (0: never), of ``least`` code points and ``times`` occurrences or more.  The
    form is the word at one edit that occurs most (ties: smallest by code point) if
    it occurs ``ratio`` times as often, else null; the root is the last form
    reached, the word itself without one.  ``ratio`` is above 1.

    Null and blank texts have no words; a null id counts as an empty one; repeated
    rows count each.  Other columns aren't read.  An empty table gives no rows.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = cut(vocabulary(docs, id_col, text_col, every, least, times))
    links = near_words(words, part_words)
    # largest near_n first, then smallest word
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    found = links.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    chosen = F.when(-F.col("best.n") >= ratio * F.col("n"), F.col("best.word"))
    table = cut(words.join(found, "word", "left").select(
        "word", chosen.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen.isNotNull(), -F.col("best.n")).alias("form_n")))
    roots = follow(table.filter("form IS NOT NULL"))
    return (table.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
