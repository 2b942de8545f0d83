"""SimHash near-duplicates by pivot distance tables.

A fingerprint has a row of Hamming distances to reference fingerprints.  The
references come in blocks: those of block ``b`` differ from one base reference
only within the bits of block ``b``, so the distances to them, taken relative
to the base, depend on these bits alone, and ``k`` differing bits move the
relative coordinates of at most ``k`` blocks.  Two fingerprints within
``max_bits`` therefore have a coordinate difference of zero on at least
``blocks - max_bits`` blocks; the coordinates of every such choice of blocks
are a bucket key.  In a bucket, pairs with a coordinate of the whole table that
differs by more than ``max_bits`` are discarded (triangle inequality) and the
survivors are verified by their exact distance.

Copies share a fingerprint and are one node, so they never make pairs.  A bucket
sends on the links of a spanning forest only (at most its size less one), and
one of more than ``bucket_rows`` fingerprints is dealt out as pairs of parts, so
no task gathers an unbounded bucket.  Components come from min-label
contraction with reliable checkpoints; links, labels and fingerprints stay
distributed.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import cut, has_rows, raw, word_chunks

BITS = 64


def simhash(data: bytes | None, shingle: int, seed: int = 42) -> int:
    """Bit ``i`` is one if it is set in over half of the XXH64 values of the
    word shingles (A-Z lowered, words split at ASCII white space, repeats
    included); no words: zero."""
    if not data:
        return 0
    total, ones = 0, np.zeros(BITS, np.int64)
    short: list[bytes] = []
    for words in word_chunks(data.lower(), shingle - 1):
        n = len(words) - shingle + 1
        if n <= 0:
            short = words
            continue
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, itertools.repeat(seed)), "<u8", n)
        for i in range(0, n, 1 << 16):
            bits = np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
        total += n
    if not total:
        if not short:
            return 0
        return xxhash.xxh64_intdigest(b" ".join(short), seed)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprint_udf(shingle: int):
    """Column function: UTF-8 bytes to the fingerprint as a (signed) long."""
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        values = np.fromiter((simhash(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(values.view(np.int64))
    return fingerprint


def references(blocks: int, per_block: int = 12, spread: int = 16, seed: int = 7):
    """(base, references of each block, further random references)."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2 ** 63, dtype=np.uint64) * np.uint64(2)
    rest = rng.integers(0, 2 ** 63, size=spread, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    groups = []
    for bits in np.array_split(np.arange(BITS), blocks):
        mask = np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
        patterns = rng.integers(0, 2 ** 63, size=per_block, dtype=np.uint64) * np.uint64(2) + rng.integers(
            0, 2, size=per_block, dtype=np.uint64)
        groups.append(base ^ (patterns & mask))
    return base, groups, rest


def distance_table(fps: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(pivot table: distances to all references, relative coordinates by block)."""
    base, groups, rest = references(blocks)
    refs = np.concatenate([[base], *groups, rest])
    full = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)
    width = len(groups[0])
    relative = full[:, 1:1 + blocks * width] - full[:, :1]
    return full, relative.reshape(len(fps), blocks, width)


def bucket_keys(fps: np.ndarray, max_bits: int, blocks: int) -> np.ndarray:
    """One 64-bit key for each fingerprint and choice of ``blocks - max_bits``
    blocks: a hash of the relative coordinates on them."""
    relative = distance_table(fps, blocks)[1].astype(np.int64).view(np.uint64)
    mult = np.random.default_rng(11).integers(0, 2 ** 63, size=relative.shape[1:], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    by_block = (relative * mult).sum(axis=2, dtype=np.uint64)
    out = []
    for i, chosen in enumerate(itertools.combinations(range(blocks), blocks - max_bits)):
        key = by_block[:, list(chosen)].sum(axis=1, dtype=np.uint64) + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2 ** 64)
        out.append(key ^ (key >> np.uint64(29)))
    return np.stack(out, axis=1)


def blocks_for(count: int, max_bits: int) -> int:
    """The fewest blocks whose keys keep accidental bucket mates below one a
    fingerprint.  The result doesn't depend on it, only the work."""
    for blocks in range(max_bits + 2, 17):
        keep = blocks - max_bits
        keys = len(list(itertools.combinations(range(blocks), keep)))
        if count * keys / 2.0 ** (BITS * keep / blocks) < 1:
            return blocks
    return 16


def forest(fps: np.ndarray, max_bits: int, blocks: int) -> list[tuple[int, int]]:
    """Links that connect what the links at ``max_bits`` or fewer bits connect:
    each node reached once, found by pivot coordinates, then verified."""
    if len(fps) == 2:
        full = distance_table(fps, blocks)[0]
        near = np.abs(full[0] - full[1]).max() <= max_bits and int(np.bitwise_count(fps[0] ^ fps[1])) <= max_bits
        return [(0, 1)] if near else []
    pivots = distance_table(fps, blocks)[0]
    left = np.arange(len(fps))
    links: list[tuple[int, int]] = []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            left = left[1:]
            continue
        at = queue.pop()
        maybe = np.abs(pivots[left] - pivots[at]).max(axis=1) <= max_bits
        near = maybe.copy()
        near[maybe] = np.bitwise_count(fps[left[maybe]] ^ fps[at]) <= max_bits
        found = left[near].tolist()
        links += [(at, x) for x in found]
        queue += found
        left = left[~near]
    return links


def _links(batches: Iterator[pa.RecordBatch], max_bits: int, blocks: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, part_a, part_b, fp) rows to links; a bucket may go on in the
    next batch."""
    held: list[np.ndarray] = []

    def out(rows: np.ndarray) -> pa.RecordBatch | None:
        a: list[int] = []
        b: list[int] = []
        starts = np.flatnonzero(np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1), True])
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if j - i > 1:
                fps = np.unique(rows[i:j, 3].astype(np.int64).view(np.uint64))
                for x, y in forest(fps, max_bits, blocks) if len(fps) > 1 else ():
                    a.append(int(fps[x]))
                    b.append(int(fps[y]))
        if not a:
            return None
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
        last = held[-1]
        cutoff = np.flatnonzero((last[:, :3] != last[-1, :3]).any(axis=1))
        if len(cutoff):
            end = int(cutoff[-1]) + 1
            done = out(np.concatenate([*held[:-1], last[:end]]))
            held = [last[end:]]
            if done:
                yield done
    if held and (done := out(np.concatenate(held))):
        yield done


def link_fingerprints(distinct: DataFrame, max_bits: int, blocks: int, bucket_rows: int = 1024) -> DataFrame:
    """``distinct`` (fp long, no repeats) to links (a, b) that connect exactly
    what all links at ``max_bits`` or fewer bits connect."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(fps), 4096):
                part = fps[i:i + 4096]
                keys = bucket_keys(part.view(np.uint64), max_bits, blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(part, keys.shape[1]))],
                    ["key", "fp"])

    rows = distinct.select("fp").mapInArrow(keyed, "key long, fp long")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    pairs = (
        rows.join(sizes, "key")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "fp")
    )
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (pairs.repartition(n, "key", "part_a", "part_b")
             .sortWithinPartitions("key", "part_a", "part_b"))
    return dealt.mapInArrow(lambda it: _links(it, max_bits, blocks), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of the links (a, b),
    by alternating large-star and small-star contraction until nothing changes;
    O(log n) rounds in practice.  Each round is aggregations and a join by node
    whose hot side Spark can split, and ends in a reliable checkpoint."""
    edges = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a <> b").distinct())
    state = None
    while True:
        # large star: each larger neighbour is linked to the smallest one around
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
        large = (both.join(low, "a").filter("b > a")
                 .select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct())
        # small star: the smaller neighbours and the node itself go to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", "low"))
        edges = cut(small.filter("a <> b").distinct())
        row = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        # stable once every node hangs on one smaller node that hangs on none
        if tuple(row) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
        state = tuple(row)


def _labelled(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int,
              bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """(id, tie, fp) of each row, ``tie`` a hash of the text; and of each
    fingerprint (fp, root, component_id), ``root`` naming the component."""
    fps = cut(docs.select(F.col(f"`{id_col}`").alias("id"),
                          F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0)).alias("tie"),
                          fingerprint_udf(shingle)(raw(text_col)).alias("fp")))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("low")))
    blocks = blocks_for(classes.count(), max_bits)
    label = components(link_fingerprints(classes, max_bits, blocks, bucket_rows))
    rooted = cut(classes.join(label, F.col("fp") == F.col("node"), "left")
                 .select("fp", F.coalesce("label", "fp").alias("root"), "low"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps, cut(rooted.join(lows, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp`` (long), ``component_id``
    (smallest id reachable over links of ``max_bits`` or fewer bits).

    Null and blank texts have fingerprint zero, linked like any other.  Repeated
    rows keep one row each; a null id keeps its row and never is the smallest,
    so a component of null ids only has a null ``component_id``.  Other columns
    of ``docs`` are not read.  An empty table gives no rows.
    """
    fps, by_fp = _labelled(docs, id_col, text_col, shingle, max_bits, bucket_rows)
    return fps.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
             max_bits: int = 3, bucket_rows: int = 1024) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of its smallest
    id (null last), then lowest fingerprint, then lowest hash of the text.  Rows
    that agree in id and text are repeated rows: one of them stays.

    The choice is made on narrow rows; the documents then meet the chosen keys.
    """
    fps, by_fp = _labelled(docs, id_col, text_col, shingle, max_bits, bucket_rows)
    rows = fps.join(by_fp.select("fp", "root"), "fp")
    order = F.struct(F.col("id").isNull().alias("last"), "id", "fp", "tie")
    kept = rows.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.id").alias("id"), F.col("k.tie").alias("tie"))
    kept = cut(kept.distinct())
    repeated = cut(fps.groupBy("id", "tie").count().filter("count > 1").select("id", "tie"))
    names = [f"__k{i}" for i in range(2)]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    on = F.col(f"`{id_col}`").eqNullSafe(F.col(names[0])) & (
        F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0)) == F.col(names[1]))
    if not has_rows(repeated):
        return docs.join(kept.toDF(*names), on, "left_semi")
    same = kept["id"].eqNullSafe(repeated["id"]) & (kept["tie"] == repeated["tie"])
    single = docs.join(kept.join(repeated, same, "left_anti").toDF(*names), on, "left_semi")
    # repeated rows may be many: the map side keeps one of each before the shuffle
    cols = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = (docs.groupBy(F.col(f"`{id_col}`").alias("a"), F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0)).alias("b"))
           .agg(F.first(cols).alias("row")))
    among = kept.join(repeated, same, "left_semi").toDF(*names)
    several = one.join(among, F.col("a").eqNullSafe(F.col(names[0])) & (F.col("b") == F.col(names[1])), "left_semi")
    return single.unionByName(several.select("row.*"))
