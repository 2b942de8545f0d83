"""Spelling variants against plain Python over all pairs."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from valora.llm import spelling


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from valora.session import ship_package
    ship_package(spark)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, every=199, least=6, times=5, ratio=5):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= least and c >= times}
    out = {}
    for w in n:
        mates = [x for x in n if near(w, x)]
        best = min(mates, key=lambda x: (-n[x], x), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (form, n[w], len(mates), None if form is None else n[form])
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return sorted((w, f, root(w), c, m, k) for w, (f, c, m, k) in out.items())


def collected(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def sample(seed=3, n=260):
    rng = random.Random(seed)
    base = ["straße", "münchen", "Àpropos", "hello", "variant", "spelling", "banana", "aaaaaa", "aaaaaaa", "aaaaaaaa", "×÷×÷×÷"]
    base += ["".join(rng.choices("abcde", k=rng.randrange(6, 10))) for _ in range(60)]
    def worn(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("abcdeéÿ") + w[i:], w[:i] + rng.choice("abcdeéÿ") + w[i + 1:]])
    pool = base * 12 + [w for x in base for w in [worn(x)] * rng.randrange(1, 4)] + [worn(worn(x)) for x in base for _ in range(4)]
    rows = []
    for i in range(n):
        rows.append((i, rng.choice([" ", ", ", "1", "\n漢", "_"]).join(
            rng.choice([str.upper, str.lower, str])(rng.choice(pool)) for _ in range(rng.randrange(0, 30)))))
    return rows + [(rows[0][0], rows[0][1])] * 7 + [(None, "nameless nameless"), (900, None), (901, ""), (902, "aaaaaaaaa " * 3000)]


@pytest.mark.parametrize("every", [199, 3])
def test_variants_against_all_pairs(spark, every):
    rows = sample()
    docs = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
            .repartition(5))
    want = brute(rows, every)
    assert collected(spelling.variants(docs, every=every)) == want
    assert any(r[1] for r in want) and (every == 3 or any(r[1] and r[2] != r[1] for r in want))


@pytest.mark.parametrize("groups,part", [(2, 3), (4, 1), (9, 5), (5, 1000)])
def test_links_do_not_depend_on_blocks(spark, groups, part):
    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abczé", k=rng.randrange(6, 9))) for _ in range(250)} | {"q" * 40, "q" * 41, "q" * 39 + "r"})
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = sorted(tuple(r) for r in spelling.near_words(df, part, groups).collect())
    n = {w: i + 1 for i, w in enumerate(words)}
    assert got == sorted((a, b, n[b]) for a in words for b in words if near(a, b))


def test_every_neighbour_of_a_word_is_in_a_neighbour_block():
    rng = random.Random(2)
    for groups in (2, 3, 6, 9):
        table = spelling.letter_groups(groups)
        steps = set(spelling.neighbours(groups))
        for _ in range(300):
            w = [rng.randrange(256) for _ in range(rng.randrange(2, 9))]
            x = list(w)
            i = rng.randrange(len(w))
            if rng.random() < 0.5:
                x[i] = rng.randrange(256)
            else:
                x.insert(i, rng.randrange(256))
            count = [np.bincount(table[np.array(y)], minlength=groups)[:groups - 1] for y in (w, x)]
            step = (len(x) - len(w), *(int(v) for v in count[1] - count[0]))
            assert step in steps or tuple(-v for v in step) in steps


def test_long_words_have_exact_distances():
    a = np.frombuffer(("a" * 5000 + "b").encode(), np.uint8).reshape(1, -1)
    b = np.stack([np.frombuffer(x.encode(), np.uint8) for x in ("a" * 5001, "a" * 4999 + "bb", "b" + "a" * 5000, "c" + "a" * 4999 + "b")])
    i, j = spelling.near_pairs(a, b, False)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 3)]


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(37)] + [("x", "y")]
    got = dict(spelling.follow(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {**{f"w{i:03d}": "w037" for i in range(37)}, "x": "y"}


def test_tables_without_words(spark):
    for rows in ([], [(1, None), (2, ""), (3, "short 123 __")]):
        assert collected(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == []
