"""The mix of sources against a version in plain Python."""
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from valora.llm import mixing


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from valora.session import ship_package
    ship_package(spark)


def brute(rows, weights=(5, 2, 1), share=1.5, most=2, seed=42):
    """(doc_id, source, size, source_size, target, taken) of every row."""
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    names = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in docs if x == s) for s in names}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, left = {}, share * sum(size.values())
    rest = set(names)
    while rest:
        rate = left / sum(weight[s] for s in rest)
        full = {s for s in rest if weight[s] * rate >= most * size[s]}
        for s in full or rest:
            target[s] = float(most * size[s]) if full else weight[s] * rate
        left -= sum(target[s] for s in full)
        rest = rest - full if full else set()
    out = []
    for s in names:
        own = sorted((hashlib.md5(f"{'' if i is None else i}:{seed}".encode()).hexdigest(), i is not None, i or 0, n)
                     for i, x, n in docs if x == s)
        order = [(i if known else None, n) for _, known, i, n in own]
        take, taken = int(target[s]), [0] * len(order)
        while take and size[s]:
            for k, (_, n) in enumerate(order):
                got = min(n, take)
                taken[k] += got
                take -= got
        out += [(i, s, n, size[s], round(target[s], 6), taken[k]) for k, (i, n) in enumerate(order)]
    return sorted(out, key=str)


def collected(mixed):
    return sorted(((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
                   for r in mixed.taken().collect()), key=str)


def sample(n=150, seed=1):
    rng = random.Random(seed)
    names = ["b", "a", "Z", "é", "long", None, "漢"]
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40])) + rng.choice(["", "\n", " \t x"]), rng.choice(names))
            for i in range(n)]
    rows += [(rows[3][0], rows[3][1], rows[3][2])] * 5 + [(None, "one two", "a")] * 3 + [(900, None, None), (901, "", "empty"), (901, "", "empty")]
    rows += [(902, "v " * 9000, "long"), (903, "   x", "b")]
    return rows


@pytest.mark.parametrize("block", [1, 7, 1024, 10**6])
def test_mix_against_plain_python(spark, block):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("key", F.lit(1)).withColumn("target", F.lit("x"))
    mixed = mixing.mix(docs, block=block)
    got = collected(mixed)
    assert got == brute(rows)
    assert all(taken <= 2 * size for _, _, size, _, _, taken in got)
    by = {r["source"]: r for r in mixed.sources.collect()}
    taken = {}
    for _, s, _, _, _, t in got:
        taken[s] = taken.get(s, 0) + t
    assert all(taken[s] == r["take"] and abs(r["take"] - r["target"]) <= 1 for s, r in by.items())


def test_pieces_are_equal_blocks_that_cover_each_source_in_turn(spark):
    docs = spark.createDataFrame(sample(), "doc_id long, text string, source string")
    mixed = mixing.mix(docs, block=16)
    size = {r["source"]: r["source_size"] for r in mixed.sources.collect()}
    words = {}
    spans = {}
    for p in mixed.pieces.collect():
        words.setdefault(p["source"], {}).setdefault(p["slot"], 0)
        words[p["source"]][p["slot"]] += p["end"] - p["start"]
        at = p["round"] * size[p["source"]] + p["at"]
        spans.setdefault(p["source"], []).append((at + p["start"], at + p["end"], p["slot"]))
    for s, by_slot in words.items():
        assert max(by_slot.values()) - min(by_slot.values()) <= 1
        row = sorted(spans[s])
        assert row[0][0] == 0 and all(a[1] == b[0] for a, b in zip(row, row[1:], strict=False))
        assert [x[2] for x in row] == sorted(x[2] for x in row)  # rank by slot is rank by block


def test_every_stretch_of_slots_is_near_the_targets(spark):
    rows = [(i, "w " * 50, "abc"[i % 3]) for i in range(300)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.0, block=10)
    source = dict(mixed.pieces.select("slot", "source").distinct().collect())
    slots = [source[k] for k in sorted(source)]
    part = {r["source"]: r["target"] / 15000 for r in mixed.sources.collect()}
    for at in range(0, len(slots) - 64, 64):
        for s, p in part.items():
            assert abs(slots[at:at + 64].count(s) - 64 * p) <= 3


def test_mix_does_not_depend_on_partitions_and_takes_tiny_sources(spark):
    rows = [(i, "w " * 500, "big") for i in range(40)] + [(100, "a b c", "small"), (101, "x", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, many = (collected(mixing.mix(docs.repartition(n))) for n in (1, 7))
    assert one == many == brute(rows)


def test_many_copies_of_one_row(spark):
    rows = [(7, "a b", "s")] * 3000 + [(8, "c", "s"), (9, "d e f", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert collected(mixing.mix(docs)) == brute(rows)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert collected(mixing.mix(docs)) == []
    docs = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert collected(mixing.mix(docs)) == [(1, None, 0, 0, 0.0, 0), (2, "a", 0, 0, 0.0, 0)]
