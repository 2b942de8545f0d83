"""Bounded-space online best-fit packing of tokenized documents.

A task tokenizes its documents, cuts those that are longer than a sequence and
puts each piece into the fullest open sequence with room.  A fixed number of
sequences are open; they are kept by free space, and the free spaces that have
any are the bits of one integer, so the best fit is the lowest set bit at or
above the piece's length.  When a new sequence must open and none is left, the
fullest closes.  There is no shuffle, and a task holds one batch of documents,
the token cache and the open sequences.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel


#: Outside these characters a text goes to the tokenizer as it is.  Within them
#: the normal form changes nothing and lower case is that of each character.
_ODD = re.compile("[^\\x00-\u012f\u0131-\u024f]")
#: Letters, then ASCII marks other than the apostrophe: two words.
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]*)([!-&(-/:-@\\[-`{-~]*)")


class WordCache(dict):
    """Token ids (little-endian unsigned 32-bit) of words between ASCII blanks.
    The tokenizer drops white space and never joins words across it, so the ids
    of a text are those of its words in turn; words of letters alone go straight
    to the tokenizer's merges.  A test holds this to the tokenizer itself.  The
    cache is emptied when it holds ``most`` words.
    """

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        self._tokenizer = Tokenizer.from_file(path)
        self._merges = self._tokenizer.model
        self._bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self._most = most

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self._most:
            self.clear()
        plain = _PLAIN.fullmatch(word)
        if not plain:
            out = self._whole(word)
        elif plain[1] and plain[2]:
            out = self[plain[1]] + self[plain[2]]
        else:
            mapped = word if word.isascii() else self._bytes.pre_tokenize_str(word)[0][0]
            out = np.array([t.id for t in self._merges.tokenize(mapped)], "<u4").tobytes()
        self[word] = out
        return out

    def encode(self, text: str) -> bytes:
        if "<|" in text or not text.isascii() and _ODD.search(text):
            return self._whole(text)
        text = text.lower()
        for blank in "\n\t\r":
            if blank in text:
                text = text.replace(blank, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


@functools.lru_cache(maxsize=2)
def _word_cache(path: str) -> WordCache:
    return WordCache(path)  # a worker keeps it for its next tasks


class BestFit:
    """Open sequences of ``limit`` tokens.  ``place`` gives (sequence, offset)."""

    def __init__(self, limit: int, most_open: int):
        self._limit, self._most = limit, most_open
        self._free = 0  # bit f: some open sequence has f tokens free
        self._at: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]
        self._open = self._next = 0

    def _take(self, free: int) -> int:
        stack = self._at[free]
        sequence = stack.pop()[0]
        if not stack:
            self._free &= ~(1 << free)
        self._open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        fits = self._free >> length << length
        if fits:
            free = (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            if self._open >= self._most:
                self._take((self._free & -self._free).bit_length() - 1)  # the fullest closes
            free, sequence = self._limit, self._next
            self._next += 1
        rest = free - length
        if rest:
            self._at[rest].append((sequence, rest))
            self._free |= 1 << rest
            self._open += 1
        return sequence, self._limit - free


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         limit: int = 2048, end_id: int = 0, open_bins: int = 4096) -> DataFrame:
    """One row per piece: ``id_col``, ``piece`` (from 0), ``start`` (ids of its
    document before it), ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``sequence_id``, ``offset``.

    A document is its ids and then ``end_id``, so a null or blank text is one
    piece of one id.  Only documents of more than ``limit`` ids are cut.
    Repeated rows are packed each; a null id stays null; other columns aren't
    read; an empty table gives no rows.  ``tokenizer_path`` must be readable on
    the executors.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bins = _word_cache(tokenizer_path), BestFit(limit, open_bins)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                own = batch.column(0).slice(i, 256)
                for at, text in enumerate(batch.column(1).slice(i, 256)):
                    ids = cache.encode(text.as_py() or "") + end
                    for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                        part = ids[4 * start:4 * (start + limit)]
                        sequence, offset = bins.place(len(part) // 4)
                        rows.append((at, piece, start, len(part) // 4, part, base + sequence, offset))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [own.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()),
                     pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.binary()),
                     pa.array(cols[5], pa.int64()), pa.array(cols[6], pa.int64())], schema.names)

    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, schema)
