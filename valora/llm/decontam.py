"""Benchmark decontamination with suffix arrays over shards of the corpus.

Every task turns its documents, a bounded shard at a time, into a word-level
suffix array.  All test suffixes are binary-searched in it at once: the
neighbours of the insertion point give the longest verbatim match of each, and
where it reaches the window width, the range of suffixes that begin with the
window gives all locations.  Words that no test item holds end a stretch: no
match crosses them, so they are terminators of the array, and stretches shorter
than the shortest window are left out of it.

Shards never leave their task; only the index of the test items is sent, in
blocks of bounded size that a task loads one after another.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import raw, word_chunks

#: Word bytes: digits, letters in lower case, everything beyond ASCII.  A-Z are
#: lowered; all else separates.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256))

RESULT = "struct<n_words:long,runs:array<struct<start:long,end:long>>,items:array<string>,longest:long>"
_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(_TABLE).split() if data else []


class TestItems:
    """Test items as word numbers: ``ids`` joins all items (0 after each);
    ``start``/``width`` are the distinct windows, ``names`` the items that hold
    each; ``rest`` is the length of the test suffix at each place."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        ids: list[int] = []
        rest: list[int] = []
        windows: dict[tuple[int, ...], tuple[int, set[str]]] = {}
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            own = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            width = min(window, len(own))
            for i in range(len(own) - width + 1):
                windows.setdefault(tuple(own[i:i + width]), (len(ids) + i, set()))[1].add(name)
            rest += range(len(own), -1, -1)
            ids += [*own, 0]
        self.ids = np.array(ids, np.int32)
        self.rest = np.array(rest, np.int64)
        self.start = np.array([v[0] for v in windows.values()], np.int64)
        self.width = np.array([len(k) for k in windows], np.int64)
        self.names = [sorted(v[1]) for v in windows.values()]
        self.longest = int(self.rest.max()) if len(rest) else 0
        self.shortest = int(self.width.min()) if len(windows) else 0


class SuffixArray:
    """Suffixes of ``seq`` (0 ends a stretch) in order of their first ``depth``
    words, by prefix doubling of tied groups only."""

    def __init__(self, seq: np.ndarray, shortest: int, depth: int):
        n = len(seq)
        zeros = np.flatnonzero(seq == 0)
        left = np.zeros(n + 1, np.int64)  # words up to the end of the stretch
        pos = np.flatnonzero(seq)
        if len(pos):
            nxt = np.searchsorted(zeros, pos)
            end = np.append(zeros, n)[nxt]
            begin = np.concatenate([[-1], zeros])[nxt] + 1
            left[pos] = end - pos
            pos = pos[end - begin >= shortest]
        self.seq, self.left = seq, left
        order = pos[np.argsort(seq[pos], kind="stable")]
        rank = np.zeros(n + 1, np.int64)
        slots = np.arange(len(order))
        key = seq[order].astype(np.int64)
        step = 1
        while True:
            first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
            starts = np.flatnonzero(first)
            group = np.cumsum(first) - 1
            rank[order[slots]] = slots[starts][group] + 1 if len(slots) else 0
            tied = np.diff(np.append(starts, len(key)))[group] > 1 if len(key) else first
            slots = slots[tied]
            if not len(slots) or step >= depth:
                break
            part = order[slots]
            second = np.where(left[part] > step, rank[np.minimum(part + step, n)], 0)
            key = rank[part] * (n + 2) + second
            by = np.argsort(key, kind="stable")
            order[slots] = part[by]
            key = key[by]
            step *= 2
        self.order = order

    def lcp(self, items: np.ndarray, start: np.ndarray, width: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Common words of each pattern and the suffix at ``at``."""
        most = np.minimum(width, self.left[at])
        out = np.zeros(len(start), np.int64)
        live = np.flatnonzero(most > 0)
        k = 0
        while len(live):
            same = items[start[live] + k] == self.seq[at[live] + k]
            live = live[same]
            k += 1
            out[live] = k
            live = live[most[live] > k]
        return out

    def search(self, items: np.ndarray, start: np.ndarray, width: np.ndarray, after: bool) -> np.ndarray:
        """Binary search of all patterns: the first suffix that isn't before the
        pattern or, with ``after``, the first behind all that begin with it."""
        lo = np.zeros(len(start), np.int64)
        hi = np.full(len(start), len(self.order), np.int64)
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            at = self.order[mid]
            common = self.lcp(items, start[live], width[live], at)
            whole = common == width[live]
            out = common == self.left[at]
            i, j = np.minimum(start[live] + common, len(items) - 1), np.minimum(at + common, len(self.seq) - 1)
            before = np.where(whole, after, out | (self.seq[j] < items[i]))
            lo[live[before]] = mid[before] + 1
            hi[live[~before]] = mid[~before]
        return lo

    def longest(self, items: np.ndarray, start: np.ndarray, width: np.ndarray) -> np.ndarray:
        """The longest match of each pattern: with a neighbour of its place."""
        if not len(self.order):
            return np.zeros(len(start), np.int64)
        at = self.search(items, start, width, False)
        return np.maximum(
            self.lcp(items, start, width, self.order[np.minimum(at, len(self.order) - 1)]),
            np.where(at > 0, self.lcp(items, start, width, self.order[np.maximum(at - 1, 0)]), 0))


def _match_shard(test: TestItems, parts: list[tuple[int, int, np.ndarray]], found: list[dict]) -> None:
    """Match one shard; ``parts``: (document, place of the first word, words)."""
    seq = np.concatenate([x for _, _, ids in parts for x in (ids, np.zeros(1, np.int32))])
    array = SuffixArray(seq, test.shortest, test.longest)
    if not len(array.order):
        return
    suffixes = np.flatnonzero(test.ids)
    longest = np.zeros(len(test.ids), np.int64)
    longest[suffixes] = array.longest(test.ids, suffixes, test.rest[suffixes])
    hit = np.flatnonzero(longest[test.start] >= test.width)
    if not len(hit):
        return
    start, width = test.start[hit], test.width[hit]
    lo, hi = (array.search(test.ids, start, width, after) for after in (False, True))
    which = np.repeat(np.arange(len(hit)), hi - lo)
    at = array.order[np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which]]
    edges = np.array([0, *np.cumsum([len(ids) + 1 for _, _, ids in parts])])
    part = np.searchsorted(edges, at, "right") - 1
    for p, w in np.unique(np.stack([part, which], axis=1), axis=0).tolist():
        found[parts[p][0]]["items"].update(test.names[hit[w]])
    cover = np.zeros(len(seq) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width[which], -1)
    inside = np.r_[False, np.cumsum(cover)[:-1] > 0, False]
    begins = np.flatnonzero(~inside[:-1] & inside[1:])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    for b, e, p in zip(begins.tolist(), ends.tolist(), (np.searchsorted(edges, begins, "right") - 1).tolist(), strict=True):
        doc, first, _ = parts[p]
        found[doc]["runs"].append((b - edges[p] + first, e - edges[p] + first))
    # the longest match of a document: each located window, extended
    for p in np.unique(part).tolist():
        own = part == p
        common = array.lcp(test.ids, start[which[own]], test.rest[start[which[own]]], at[own])
        doc = found[parts[p][0]]
        doc["longest"] = max(doc["longest"], int(common.max()))


def match_texts(test: TestItems, texts: list[bytes | None], shard_words: int) -> list[dict]:
    """Word counts, hit runs, items and longest match of each text."""
    found = [{"n_words": 0, "runs": [], "items": set(), "longest": 0} for _ in texts]
    parts: list[tuple[int, int, np.ndarray]] = []
    size = 0
    keep = max(test.longest - 1, 0)
    for doc, text in enumerate(texts):
        at = 0
        for words in word_chunks(text.translate(_TABLE), keep) if text else ():
            ids = np.fromiter(map(test.vocab.get, words, repeat(0)), np.int32, len(words))
            found[doc]["n_words"] = at + len(words)
            if ids.any():
                parts.append((doc, at, ids))
                size += len(ids)
            at = max(at, at + len(words) - keep) if len(words) >= keep else at
            if size >= shard_words:
                _match_shard(test, parts, found)
                parts, size = [], 0
    if parts:
        _match_shard(test, parts, found)
    return found


def _merged(runs: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for b, e in sorted(runs):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([int(b), int(e)])
    return [{"start": b, "end": e} for b, e in out]


def match_udf(bench: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = 10,
              shard_words: int = 1 << 20, block_bytes: int = 32 << 20):
    """Column function: UTF-8 bytes to ``RESULT`` (words; runs of hit words; test
    items found, by name; longest verbatim match in words, 0 if no window is).

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  Null and blank items have none.  Test items go
    out in blocks of about ``block_bytes`` of text; each broadcast holds one.
    """
    size = bench.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    n_blocks = max(1, -(-size // block_bytes))
    named = bench.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("name"),
                         raw(text_col).alias("text"))
    sc = bench.sparkSession.sparkContext
    sent = []
    for b in range(n_blocks):
        rows = named.filter(F.pmod(F.xxhash64("name", "text"), F.lit(n_blocks)) == b).collect()
        sent.append(sc.broadcast(TestItems([(r["name"], r["text"] and bytes(r["text"])) for r in sorted(rows, key=lambda r: (r["name"], r["text"] or b""))], window)))

    @F.arrow_udf(RESULT)
    def match(texts: pa.Array) -> pa.Array:
        rows = [t.as_py() for t in texts]
        out: list[dict] | None = None
        for block in sent:
            got = match_texts(block.value, rows, shard_words)
            if len(sent) > 1:
                block.__dict__.pop("_value", None)  # one block in memory at a time
            if out is None:
                out = got
            else:
                for a, b in zip(out, got, strict=True):
                    a["runs"] += b["runs"]
                    a["items"] |= b["items"]
                    a["longest"] = max(a["longest"], b["longest"])
        return pa.array([x | {"runs": _merged(x["runs"]), "items": sorted(x["items"])} for x in out or ()], _ARROW)
    return match


def find_contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       window: int = 10) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``n_words``, ``runs``, ``items``,
    ``longest``.  Null and blank texts have no words and no hits; repeated rows
    keep one row each; a null id stays null; other columns aren't read; an empty
    table on either side gives no rows or no hits."""
    found = match_udf(bench, window=window)(raw(text_col))
    return docs.select(F.col(f"`{id_col}`").alias(id_col), found.alias("found")).select(id_col, "found.*")


def decontaminate(docs: DataFrame, bench: DataFrame, text_col: str = "text", window: int = 10) -> DataFrame:
    """``docs``, all columns, without the rows that hold a window of a test item."""
    found = match_udf(bench, window=window)(raw(text_col))
    return docs.filter(F.size(found["items"]) == 0)
