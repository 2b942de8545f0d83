"""Alignment of two tokenizers against whole texts in plain Python."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from valora.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from valora.session import ship_package
    ship_package(spark)


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def tokens(text, tools):
    """(ids, bytes) of both tokenizers for one whole text, or None."""
    if not text:
        return None
    a, b = tools
    letter = alignment.byte_of_letter()
    ids = a.encode(" " + text, add_special_tokens=False).ids
    x = [(i, bytes(letter[c] for c in a.id_to_token(i))) for i in ids]
    y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode())
         for i in b.encode(text)]
    whole = (" " + text).encode()
    return (x, y) if b"".join(t for _, t in x) == whole == b"".join(t for _, t in y) else None


def brute(rows, tools):
    links, groups, n = [], [], []
    for _, text in rows:
        got = tokens(text, tools)
        links.append(Counter())
        groups.append("")
        n.append((0, 0, 0))
        if not got:
            continue
        x, y = got
        ends = [np.cumsum([len(t) for _, t in z]).tolist() for z in got]
        common = sorted(set(ends[0]) & set(ends[1]))
        i = j = 0
        parts = []
        for c in common:
            p, q = i, j
            while i < len(x) and ends[0][i] <= c:
                i += 1
            while j < len(y) and ends[1][j] <= c:
                j += 1
            parts.append(",".join(str(k) for k, _ in x[p:i]) + "|" + ",".join(str(k) for k, _ in y[q:j]))
        groups[-1] = ";".join(parts)
        n[-1] = (len(x), len(y), len(parts))
        for (k, t), e in zip(x, ends[0], strict=True):
            for (m, u), f in zip(y, ends[1], strict=True):
                if e - len(t) < f and f - len(u) < e:
                    links[-1][k, m] += 1
    count = Counter(p for x in links for p in x)
    best = defaultdict(int)
    for (a, _), c in count.items():
        best[a] = max(best[a], c)
    return sorted(((i, *k, sum(x.values()), sum(m for p, m in x.items() if count[p] == best[p[0]]),
                    sum(m * count[p] for p, m in x.items()), hashlib.sha256(g.encode()).hexdigest() if g else "")
                   for (i, _), x, g, k in zip(rows, links, groups, n, strict=True)), key=str), count


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def collected(got):
    return sorted((tuple(r) for r in got.documents.select("doc_id", *NAMES).collect()), key=str)


def sample(n=90, seed=5):
    rng = random.Random(seed)
    words = ["the", "Hello", "it's", "we'll", "naïve", "straße", "漢字", "😀", "x1y2", "12345", "...", "();", "<s>", "</s>", "<|endoftext|>",
             "<0x41>", "éa", "ȷ", "end.", "a\r", "　", "\xa0", "\x00", "​", "don't", "ERROR:", "unbelievable", "thonintions", "aaaaaaaa" * 20]
    blanks = [" "] * 12 + ["\n", "  ", "\t", "\n\n", " \n ", "   ", "\n  ", "\t\t"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(blanks) for _ in range(rng.randrange(0, 40)))) for i in range(n)]
    rows += [(100, None), (101, ""), (102, " "), (103, "\n"), (104, "  \n\t"), (105, "a▁b"), (106, "▁"), (None, "the naïve end."), (0, rows[0][1])]
    rows += [(107, "\nline\n\n next "), (108, " lead"), (109, "word " * 3000), (110, "z" * 5000), (111, "á   b"), (112, "<s>"), (113, "x\r\ny")]
    return rows


@pytest.mark.parametrize("docs,postings", [(1 << 16, 1 << 20), (7, 1 << 20), (1 << 16, 50)])
def test_alignment_against_whole_texts(spark, tools, docs, postings):
    rows = sample()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit("x")).withColumn("block", F.lit(1))
    got = alignment.align_documents(df.repartition(3), *PATHS, block_docs=docs, block_postings=postings)
    want, count = brute(rows, tools)
    assert collected(got) == want
    assert sum(1 for r in want if r[1]) > 60
    assert {(r["a"], r["b"]): r["documents"] for r in got.pairs.collect()} == dict(count)
    links = sum(r[4] for r in want)
    assert got.pairs.agg(F.sum("links")).first()[0] == links


def test_words_in_turn_are_the_whole_text(tools):
    rng = random.Random(8)
    aligner = alignment.Aligner(*PATHS)
    letters = "ab'.,;1 \n\té漢😀-_<>|\\/()Zß"
    texts = ["".join(rng.choices(letters, k=rng.randrange(1, 60))) for _ in range(1500)]
    assert aligner.by_word
    for t, (table, idx) in zip(texts, aligner.documents(texts), strict=True):
        got = tokens(t, tools)
        assert bool(table.good[idx].all()) == (got is not None), t
        if got:
            assert (int(table.n_a[idx].sum()), int(table.n_b[idx].sum())) == (len(got[0]), len(got[1])), t
            shown = b";".join(table.groups[i] for i in idx).decode().split(";")
            assert [int(k) for g in shown for k in g.split("|")[0].split(",")] == [i for i, _ in got[0]], t
            assert [int(k) for g in shown for k in g.split("|")[1].split(",")] == [i for i, _ in got[1]], t


def test_bitmaps_of_both_kinds_give_their_postings():
    rng = np.random.default_rng(3)
    docs = 300
    key = np.unique(np.concatenate([rng.integers(0, 40, 500) << 16 | rng.integers(0, docs, 500), 41 << 16 | np.arange(0, 300, 2)]))
    cols = alignment.bitmaps(key & 0xFFFF, key >> 16, docs)
    dense = cols["dense"].to_numpy(zero_copy_only=False)
    assert dense.any() and not dense.all()
    assert cols["n"].to_pylist() == np.unique(key >> 16, return_counts=True)[1].tolist()
    weight = rng.integers(0, 1 << 44, len(dense))
    into = np.zeros((2, docs + 7), np.int64)
    alignment.add_postings(into, cols["docs"], dense, weight, np.ones(len(dense), np.int64))
    want = np.zeros_like(into)
    by_pair = dict(zip(cols["pair"].to_pylist(), weight.tolist(), strict=True))
    for k in key.tolist():
        want[0, k & 0xFFFF] += by_pair[k >> 16]
        want[1, k & 0xFFFF] += 1
    assert (into == want).all()


def test_memory_of_words_starts_anew(spark, tools, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_WORDS", 5)
    aligner = alignment.Aligner(*PATHS)
    for t in ["one two three four five six seven", "eight nine ten", "one two " + "q" * 300]:
        (table, idx), = aligner.documents([t])
        assert int(table.n_a[idx].sum()) == len(tokens(t, tools)[0])


def test_tables_without_tokens(spark):
    got = alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), *PATHS)
    assert collected(got) == [] and got.pairs.count() == 0
    got = alignment.align_documents(spark.createDataFrame([("x", None), ("y", "")], "doc_id string, text string"), *PATHS, keep_groups=True)
    assert collected(got) == [(k, 0, 0, 0, 0, 0, 0, "") for k in "xy"]
    assert [r["groups"] for r in got.documents.collect()] == ["", ""]
