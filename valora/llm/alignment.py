"""Alignment of two tokenizers' tokens by inverted pair bitmaps.

A text with a space before it is encoded by a byte-level tokenizer (A) and a
piece tokenizer (B).  Byte offsets where tokens of both end cut it into groups;
an A and a B token whose bytes overlap are a link.

Neither tokenizer joins bytes across the start of white space after a word, so
the tokens of a text are those of its words with the white space before them,
and a task aligns a word once and remembers it (a test holds this to whole
texts).  Texts with other white space than blank, tab and line feed go to the
tokenizers whole.

A task numbers its documents in blocks.  For each pair of ids that a block's
documents hold linked, a row has the block's bitmap of these documents (as 16-bit
numbers or as bits, whichever is shorter), and one more for each binary digit of
the links beyond the first in a document: the multiplicity planes.  Bitmaps of
different blocks are disjoint, so their union is counted by adding popcounts:
the documents of a pair, and with the planes its links.  The rows, once written,
meet their pair's count and go back to their block, where the postings add the
counts up by document.  No task holds more than one block, and nothing but the
blocks' rows is shuffled.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from valora.llm.common import scratch_path, spread

_WORD = re.compile("[ \n\t]+[^ \n\t]+|[ \n\t]+$")
#: Texts with these go to the tokenizers whole.
_ODD = re.compile("[\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　▁]")
_B_BITS = 16
#: Documents and postings of a block.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 20
#: Words a worker remembers, and the longest of them.
MOST_WORDS, LONGEST_WORD = 400_000, 128


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable
    Latin-1 characters stand for themselves, the other bytes follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64)


def _by_text(values: np.ndarray, ids: list[list[int]]) -> np.ndarray:
    """Sums of the values of each text's tokens."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
    upto = np.concatenate([[0], np.cumsum(values)])
    return np.diff(upto[np.concatenate([[0], ends])])


@dataclass
class Aligned:
    """Alignment of a list of texts.  ``links`` are pair keys of text ``i`` from
    ``first[i]`` to ``first[i + 1]``."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[bytes]
    first: np.ndarray
    links: np.ndarray


class Aligner:
    """Both tokenizers, and what is known of words."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self._a = Tokenizer.from_file(path_a)
        self._a.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letter = byte_of_letter()
        vocabulary = self._a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(letter[c] for c in token)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(pieces)]
        if len(self.bytes_b) > 1 << _B_BITS:
            raise ValueError("the second vocabulary has more than 65,536 ids")
        self._blank = self._b.piece_to_id("▁")
        own = [p for i, p in enumerate(pieces) if not self._b.is_byte(i)]
        # else its tokens may cross from a word into the white space after it
        self.by_word = not any("▁" in p.lstrip("▁") or set(p) & set(" \n\t") for p in own)
        self._size_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self._size_b = np.array([len(x) for x in self.bytes_b], np.int64)
        self._shown = [f"{i}{mark}" for mark in ",|;\n" for ids in (self.bytes_a, self.bytes_b) for i in range(len(ids))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self._parts: list[Aligned] = []
        self._all: Aligned | None = None

    def words(self, text: str) -> list[str]:
        """The texts to align whose tokens in turn are those of space + ``text``."""
        spaced = " " + text
        return _WORD.findall(spaced) if self.by_word and not _ODD.search(text) else [spaced]

    def _encode_b(self, texts: list[str]) -> list[list[int]]:
        """Tokens of texts that begin with white space: the tokenizer adds one blank
        of its own, which stands for the first or is taken off again."""
        own = [t[0] == " " for t in texts]
        out = self._b.encode([t[1:] if x else t for t, x in zip(texts, own, strict=True)], num_threads=1)
        for i, t in enumerate(texts):
            if t == " ":
                out[i] = [self._blank]
            elif not own[i]:
                out[i] = out[i][1:] if out[i][:1] == [self._blank] else []
        return out

    def _joined(self, texts: list[str], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Of which texts both tokenizers' bytes are the text's."""
        sizes = np.array([len(t.encode()) for t in texts], np.int64)
        data = "".join(texts).encode()
        if all(b"".join(map(table.__getitem__, chain.from_iterable(ids))) == data
               and (_by_text(size[_flat(ids)], ids) == sizes).all()
               for ids, table, size in ((a, self.bytes_a, self._size_a), (b, self.bytes_b, self._size_b))):
            return np.ones(len(texts), bool)
        return np.array([b"".join(map(self.bytes_a.__getitem__, x)) == t.encode() == b"".join(map(self.bytes_b.__getitem__, y))
                         for t, x, y in zip(texts, a, b, strict=True)])

    def align(self, texts: list[str]) -> Aligned:
        a = [e.ids for e in self._a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self._encode_b(texts)
        good = self._joined(texts, a, b)
        for i in np.flatnonzero(~good):
            a[i], b[i] = [], []
        n_a, n_b = (np.fromiter(map(len, x), np.int64, len(texts)) for x in (a, b))
        ids_a, ids_b = _flat(a), _flat(b)
        # all texts end to end: both tokenizers reach the same offset at each text's end
        end_a, end_b = np.cumsum(self._size_a[ids_a]), np.cumsum(self._size_b[ids_b])
        start_a, start_b = end_a - self._size_a[ids_a], end_b - self._size_b[ids_b]
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
        each = high - low
        at = np.repeat(low - (np.cumsum(each) - each), each) + np.arange(each.sum())
        links = np.repeat(ids_a, each) << _B_BITS | ids_b[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        ends = np.concatenate([[0], np.cumsum(n_a)])
        first_group = np.concatenate([group_a, [len(common)]])[ends]
        shown = self._group_texts(ids_a, ids_b, n_a, n_b, group_a, group_b)
        return Aligned(good, n_a, n_b, np.diff(first_group), shown, upto[ends], links)

    def _group_texts(self, ids_a, ids_b, n_a, n_b, group_a, group_b) -> list[bytes]:
        """Per text its groups, written out: the tokens by group, A before B, each
        with the mark that stands between it and the next."""
        text = np.concatenate([np.repeat(np.arange(len(n)), n) for n in (n_a, n_b)])
        side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        group = np.concatenate([group_a, group_b])
        order = np.lexsort((side, group))
        text, side, group = text[order], side[order], group[order]
        mark = np.full(len(order), 3)
        mark[:-1] = np.select([text[1:] != text[:-1], group[1:] != group[:-1], side[1:] != side[:-1]], [3, 2, 1], 0)
        ids = np.concatenate([ids_a, ids_b + len(self.bytes_a)])[order]
        rows = iter("".join(map(self._shown.__getitem__, (mark * (len(self._shown) // 4) + ids).tolist())).encode().split(b"\n"))
        return [next(rows) if n else b"" for n in n_a.tolist()]

    def learn(self, texts: list[str]) -> None:
        """Align texts and remember them."""
        if not texts:
            return
        got = self.align(texts)
        for t in texts:
            self.known[t] = len(self.known)
        old = self._all
        if old is None:
            self._all = got
            return
        self._all = Aligned(
            *(np.concatenate([getattr(old, n), getattr(got, n)]) for n in ("good", "n_a", "n_b", "n_groups")),
            old.groups, np.concatenate([old.first, got.first[1:] + old.first[-1]]), np.concatenate([old.links, got.links]))
        old.groups.extend(got.groups)

    def documents(self, texts: list[str]) -> Iterator[tuple[Aligned, np.ndarray]]:
        """For each text the table of its words and their numbers in it."""
        words = [self.words(t) if t else [] for t in texts]
        if len(self.known) > MOST_WORDS:
            self.forget()
        new = set().union(*(w for w in words if len(w) != 1 or len(w[0]) <= LONGEST_WORD)).difference(self.known)
        self.learn(sorted(w for w in new if len(w) <= LONGEST_WORD))
        for own in words:
            if not own:
                yield None, np.zeros(0, np.int64)
                continue
            rest = [w for w in dict.fromkeys(own) if w not in self.known]
            if not rest:
                yield self._all, np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))
                continue
            # long words are of no use to other documents: a table of this one
            names = list(dict.fromkeys(own))
            place = {w: i for i, w in enumerate(names)}
            yield self.align(names), np.fromiter(map(place.__getitem__, own), np.int64, len(own))


@functools.lru_cache(maxsize=1)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)  # a worker keeps it for its next tasks


# -------------------------------------------------------------------- bitmaps
def bitmaps(doc: np.ndarray, pair: np.ndarray, docs: int) -> dict[str, pa.Array]:
    """Columns pair, dense, docs, n of one row per pair: its documents, given
    sorted by (pair, doc), as 16-bit numbers or, if that is shorter, bits."""
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.zeros(0, np.int64)
    n = np.diff(np.r_[starts, len(pair)])
    dense = n * 2 > (docs + 7) // 8
    keep = np.repeat(~dense, n)
    sparse = doc[keep].astype("<u2")
    sizes = np.where(dense, (docs + 7) // 8, n * 2)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    data = np.zeros(ends[-1], np.uint8)
    data[np.repeat(~dense, sizes)] = sparse.view(np.uint8)
    for i in np.flatnonzero(dense):
        bits = np.zeros(docs, np.uint8)
        bits[doc[starts[i]:starts[i] + n[i]]] = 1
        data[ends[i]:ends[i + 1]] = np.packbits(bits, bitorder="little")
    maps = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return {"pair": pa.array(pair[starts]), "dense": pa.array(dense), "docs": maps.cast(pa.binary()), "n": pa.array(n.astype(np.int32))}


def add_postings(into: np.ndarray, maps: pa.Array, dense: np.ndarray, *weights: np.ndarray) -> None:
    """Add each row's weights (whole numbers) to the documents of its bitmap;
    ``into`` is weights x documents."""
    offsets = np.frombuffer(maps.buffers()[1], np.int32)[maps.offset:maps.offset + len(maps) + 1].astype(np.int64)
    data = np.frombuffer(maps.buffers()[2], np.uint8) if len(maps) and maps.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    body = data[offsets[0]:offsets[-1]]
    doc = body[np.repeat(~dense, sizes)].view("<u2")
    times = sizes[~dense] // 2
    for row, weight in enumerate(weights):
        own = weight[~dense]
        # halves, so that sums of floating numbers stay exact
        for part, scale in ((own & 0xFFFFF, 1), (own >> 20, 1 << 20)):
            if part.any():
                got = np.bincount(doc, np.repeat(part, times), minlength=into.shape[1])
                into[row] += got.astype(np.int64) * scale
    for i in np.flatnonzero(dense):
        bits = np.unpackbits(data[offsets[i]:offsets[i + 1]], bitorder="little")
        at = np.flatnonzero(bits)
        for row, weight in enumerate(weights):
            into[row, at] += weight[i]


_DOC = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups"]


def _schema(id_type: T.DataType) -> T.StructType:
    """A document's row, or a bitmap's."""
    out = T.StructType.fromDDL("posting boolean, block long, at int").add("id", id_type)
    for f in T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
                                  "pair long, plane int, dense boolean, docs binary, n int"):
        out = out.add(f)
    return out


class _Block:
    """The documents of a block and their postings."""

    def __init__(self, number: int):
        self.number, self.rows, self.postings, self.size = number, [], [], 0

    def add(self, table: Aligned | None, idx: np.ndarray, keep_groups: bool) -> None:
        """One document, from its words."""
        if table is None or not table.good[idx].all():
            self.rows.append((0, 0, 0, 0, "", "" if keep_groups else None))
            return
        text = b";".join(map(table.groups.__getitem__, idx.tolist()))
        words, times = np.unique(idx, return_counts=True)
        each = table.first[words + 1] - table.first[words]
        at = np.repeat(table.first[words] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        pair, place = np.unique(table.links[at], return_inverse=True)
        links = np.bincount(place, np.repeat(times, each)).astype(np.int64)
        doc = len(self.rows)
        self.postings.append((pair << 16 | doc, links))
        self.size += len(pair)
        self.rows.append((int(table.n_a[idx].sum()), int(table.n_b[idx].sum()), int(table.n_groups[idx].sum()), int(links.sum()),
                          hashlib.sha256(text).hexdigest(), text.decode() if keep_groups else None))

    def columns(self, ids: list[pa.Array]) -> Iterator[dict[str, pa.Array]]:
        """Columns of the documents' rows, then of the bitmaps by plane."""
        fields = zip(_DOC, zip(*self.rows, strict=True), strict=True)
        yield {"at": pa.array(np.arange(len(self.rows), dtype=np.int32)), "id": pa.concat_arrays(ids),
               **{n: pa.array(v, pa.string() if n.startswith("groups") else pa.int64()) for n, v in fields}}
        if not self.postings:
            return
        key = np.concatenate([p[0] for p in self.postings])
        more = np.concatenate([p[1] for p in self.postings]) - 1
        order = np.argsort(key, kind="stable")
        key, more = key[order], more[order]
        for plane in range(-1, int(more.max()).bit_length()):
            have = key if plane < 0 else key[more >> plane & 1 == 1]
            cols = bitmaps(have & 0xFFFF, have >> 16, len(self.rows))
            yield {**cols, "plane": pa.array(np.full(len(cols["pair"]), plane, np.int32))}


def _inverted(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str, schema: pa.Schema, keep_groups: bool,
              block_docs: int, block_postings: int, chars: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) to rows of documents and bitmaps, block by block."""
    aligner = _aligner(path_a, path_b)
    number = TaskContext.get().partitionId() << 32
    block, ids = _Block(number), []

    def out() -> Iterator[pa.RecordBatch]:
        for cols in block.columns(ids):
            n = len(next(iter(cols.values())))
            cols |= {"posting": pa.array(np.full(n, "pair" in cols)), "block": pa.array(np.full(n, block.number))}
            yield pa.RecordBatch.from_arrays(
                [cols[f.name].cast(f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    for batch in batches:
        at = 0
        sizes = np.cumsum([len(t) if (t := x.as_py()) else 0 for x in batch.column(1)])
        while at < batch.num_rows:
            done = sizes[at - 1] if at else 0
            end = min(max(at + 1, int(np.searchsorted(sizes, done + chars))), at + block_docs - len(block.rows), batch.num_rows)
            for table, idx in aligner.documents(batch.column(1).slice(at, end - at).to_pylist()):
                block.add(table, idx, keep_groups)
            ids.append(batch.column(0).slice(at, end - at))
            at = end
            if len(block.rows) >= block_docs or block.size >= block_postings:
                yield from out()
                number += 1
                block, ids = _Block(number), []
    if block.rows:
        yield from out()


def _scores(batches: Iterator[pa.RecordBatch], block_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, plane, dense, docs, count, best), sorted by block, to rows
    (block, at, n_best, count_sum)."""
    number: int | None = None
    into = np.zeros((2, block_docs + 7), np.int64)

    def out() -> pa.RecordBatch:
        at = np.flatnonzero(into[1])
        batch = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(at), number)), pa.array(at.astype(np.int32)), pa.array(into[0, at]), pa.array(into[1, at])],
            ["block", "at", "n_best", "count_sum"])
        into[:] = 0
        return batch

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
        for p, q in zip(cuts, cuts[1:], strict=False):
            if p == q:
                continue
            if number is not None and number != blocks[p]:
                yield out()
            number = int(blocks[p])
            part = batch.slice(p, q - p)
            plane = part.column(1).to_numpy().astype(np.int64)
            dense = part.column(2).to_numpy(zero_copy_only=False)
            links = np.int64(1) << np.maximum(plane, 0)
            best = part.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            add_postings(into, part.column(3), dense, links * best, links * part.column(4).to_numpy())
    if number is not None:
        yield out()


@dataclass(frozen=True)
class Alignment:
    """``documents``: one row per document; ``pairs``: a, b, documents, links of each
    linked pair of ids in the corpus."""

    documents: DataFrame
    pairs: DataFrame


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    keep_groups: bool = False, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> Alignment:
    """``documents``: ``id_col``, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256 of each row of ``docs``, and ``groups`` (the ids of each group) if
    they are to be kept.

    Null and empty texts, and texts whose tokens' bytes of either tokenizer don't
    join to space + text, have no tokens: zeros and ''.  Repeated rows are documents
    of their own, a null id keeps its row, other columns aren't read.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = _schema(docs.schema[id_col].dataType)
    block_docs = min(block_docs, BLOCK_DOCS)
    path = scratch_path(spark, "alignment")
    rows = spread(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")))
    arrow = to_arrow_schema(schema)
    (rows.mapInArrow(lambda it: _inverted(it, path_a, path_b, arrow, keep_groups, block_docs, block_postings), schema)
     .write.parquet(path))
    stored = spark.read.schema(schema).parquet(path)
    postings = stored.filter("posting")
    once = F.col("plane") < 0
    counts = postings.groupBy("pair").agg(
        F.sum(F.when(once, F.col("n")).otherwise(0)).alias("count"),
        F.sum(F.col("n") * F.when(once, 1).otherwise(F.expr("shiftleft(1L, greatest(plane, 0))"))).alias("links"))
    ids = counts.select("pair", F.shiftright("pair", _B_BITS).alias("a"),
                        F.col("pair").bitwiseAND(F.lit((1 << _B_BITS) - 1)).alias("b"), F.col("count").alias("documents"), "links")
    # an A id has at most as many pairs as B has ids
    scored = ids.withColumn("best", F.col("documents") == F.max("documents").over(Window.partitionBy("a")))
    met = (postings.select("pair", "block", "plane", "dense", "docs")
           .join(scored.select("pair", F.col("documents").alias("count"), "best"), "pair")
           .select("block", "plane", "dense", "docs", "count", "best"))
    sums = (met.repartition(shuffles, "block").sortWithinPartitions("block")
            .mapInArrow(lambda it: _scores(it, block_docs), "block long, at int, n_best long, count_sum long"))
    zero = F.lit(0).cast("long")
    out = (stored.filter("NOT posting").join(sums, ["block", "at"], "left")
           .select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                   F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256", *(["groups"] if keep_groups else [])))
    return Alignment(out, ids.drop("pair"))
