"""Top-k, WARC, packing, SimHash and the pipeline, against brute force."""
import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from valora.llm import packing, simhash, topk, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from valora.session import ship_package
    ship_package(spark)


# ---- top-k

def brute_topk(rows, asked, k):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in asked:
        if q is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        f = [int(np.floor(256 * x)) for x in v]
        scored = [(sum(a * int(np.floor(256 * b)) for a, b in zip(f, w)), i) for i, w in ok if i != q and len(w) == len(v)]
        scored.sort(key=lambda s: (-s[0], s[1] is None, s[1] or 0))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("k, bins, block", [(5, 1024, 4096), (3, 4, 7), (40, 16, 4096)])
def test_topk_against_brute_force(spark, k, bins, block):
    rng = np.random.default_rng(k)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=6))]) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # a common vector: ties
    rows += [(200, None), (201, [float("nan")] * 6), (202, [None] * 6), (203, [float("inf")] + [0.0] * 5), (210, [0.0] * 6),
             (204, [1.0, 2.0]), (205, [3.0, 4.0]), (None, rows[5][1]), (7, rows[7][1]), (220, []), (230, [])]
    d = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int").repartition(5)
    asked = d.filter("vec_id % 10 = 0 or vec_id is null or vec_id = 204")
    want = brute_topk(rows, [r for r in rows if r[0] is None or r[0] % 10 == 0 or r[0] == 204], k)
    got = [tuple(r) for r in topk.top_k(d, asked, k=k, bins=bins, block=block).collect()]
    assert sorted(got, key=str) == want


def test_topk_of_empty_tables(spark):
    d = spark.createDataFrame([(50, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(d, d.limit(0)).count() == 0 and topk.top_k(d.limit(0), d).count() == 0
    assert topk.top_k(d, d).count() == 0


def test_large_products_are_exact():
    a = np.array([[2.0 ** 40, -3.0]])
    assert topk.inner(a, np.array([[2.0 ** 20, 7.0]]))[0, 0] == 2 ** 60 - 21
    assert topk.inner(a, np.array([[2.0 ** 60, 0.0]]))[0, 0] == 2 ** 63 - 1


# ---- WARC

def test_warc_round_trip(spark, tmp_path):
    big = "<p>x</p>" * 30
    rows = [(5, "http://a/%20é\r\nX: y", big), (3, "u", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, "u", None),
            (6, "u", ""), (7, "u", "é" * 50), (8, "u", "y" * 99), (10, "u", "y" * 99), (None, "u", big), (11, "u", "\0" * 200)]
    rng = random.Random(1)
    rows += [(100 + i, f"u{i}", "".join(rng.choices("abc \n<>", k=rng.randrange(3000)))) for i in range(60)]
    rows += [(300, "u", big), (300, "u", big)]
    d = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, payload int").repartition(3)
    path = f"file://{tmp_path}/w"
    warc.write_archives(d, path, archive_bytes=2000)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows)
    lead = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 100 and i is not None:
            lead[h] = min(i, lead.get(h, i))
    want = []
    for i, u, h in rows:
        data = (h or "").encode()
        to = lead.get(h) if lead.get(h) != i else None
        want.append((i, u, "revisit" if to is not None else "response", to, len(data), hashlib.sha256(data).hexdigest(),
                     None if to is not None else data))
    have = [(*list(r)[:6], None if r["payload"] is None else bytes(r["payload"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    files = list((tmp_path / "w").glob("part-*"))
    assert len(files) > 5 and all(len(f.read_bytes()) < 10_000 for f in files)
    whole = gzip.decompress(files[0].read_bytes())  # any gzip tool reads the file
    assert whole.startswith(b"WARC/1.1\r\n")


def test_warc_of_an_empty_table(spark, tmp_path):
    d = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(d, f"file://{tmp_path}/w")
    assert warc.read_archives(spark, f"file://{tmp_path}/w").count() == 0


def test_damaged_archives_raise():
    one = warc.record(1, "u", b"hello" * 40, None)
    text = zlib.decompress(one, 31)
    assert [len(x) for x in warc.members(one + b"\0\0" + one)] == [len(text)] * 2
    for bad in (text.replace(b"hello", b"hellO", 1), text[:-1], text.replace(b"WARC/1.1", b"WRAC/1.1"), text + b"x"):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)
    with pytest.raises(warc.WarcError):
        list(warc.members(one[:-9]))
    with pytest.raises(warc.WarcError):
        list(warc.members(b"not gzip at all"))


# ---- packing

TEXTS = [None, "", " ", "Hello, World's END!! don't", "it's 'S á ń İ ΑΣ ς Straße ÀÉÎ", "a\x1cb c\x0b\x0cd e f", "<|endoftext|> <|ENDOFTEXT|>x",
         "x<|startoftext|>'ll", "ÑAND... %%%&&& [x] {y} ~z~ `w` ^v^ -- _ __a__ a_b", "１２ ½ ² 3.14 v2.0", "漢字 かな", "\r\n\tTab\t", "ǅ ǆ ɏ ə ª º µ × ÷",
         "'sss 'RE re've I'M", "word " * 5000, "ciónosción,lbgf! " * 700]


@pytest.fixture(scope="module")
def packed_rows(spark):
    rng = random.Random(9)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choices("the of öße, thing. x! ñandú".split(), k=rng.randrange(900)))) for i in range(80)]
    rows += [(None, "nameless"), (100, rows[-3][1])]
    d = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, piece int").repartition(2)
    return rows, packing.pack(d, TOKENIZER, limit=512, open_bins=6).collect()


def test_pieces_are_the_tokenizers_ids(packed_rows):
    rows, got = packed_rows
    real = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, t in rows:
        ids = [*real.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, p, s, len(ids[s:s + 512]), np.array(ids[s:s + 512], "<u4").tobytes()) for p, s in enumerate(range(0, len(ids), 512))]
    have = [(r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_sequences_are_gapless_and_few(packed_rows):
    _, got = packed_rows
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(by) <= 1.15 * sum(r["length"] for r in got) / 512 + 2 * 6


def test_fullest_sequence_closes_first():
    bins = packing.BestFit(10, 2)
    assert bins.place(6) == (0, 0) and bins.place(7) == (1, 0)
    assert bins.place(3) == (1, 7)  # best fit: into the fuller one, which is full now
    assert bins.place(8) == (2, 0)
    assert bins.place(9) == (3, 0)  # the one of 8 closed
    assert bins.place(4) == (0, 6)
    assert bins.place(10) == (4, 0)


def test_packing_an_empty_table(spark):
    d = spark.createDataFrame([], "doc_id string, text string")
    out = packing.pack(d, TOKENIZER)
    assert out.count() == 0 and out.schema["doc_id"].dataType.simpleString() == "string"


# ---- SimHash

def brute_simhash(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, fps):
    par = list(range(len(rows)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                par[root(i)] = root(j)
    return [root(i) for i in range(len(rows))]


def corpus():
    rng = random.Random(6)
    base = [" ".join(rng.choices([f"w{i}" for i in range(400)], k=rng.randrange(30, 300))) for _ in range(25)]
    rows = []
    for i, b in enumerate(base):
        for _ in range(rng.choice([1, 1, 2, 8])):
            w = b.split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = "changed"
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(w) if i % 2 else " ".join(w).upper()))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one two"), (905, "ONE"), (906, "a b c d"), (0, rows[0][1]),
             (1, "another text with a known id"), (None, base[2]), (None, "a text of nobody else"), (None, "a text of nobody else")]
    return rows


def test_near_duplicates_against_brute_force(spark):
    rows = corpus()
    fps = [brute_simhash(t) for _, t in rows]
    comp = brute_components(rows, fps)
    low = {c: min((i for (i, _), x in zip(rows, comp) if x == c and i is not None), default=None) for c in comp}
    want = sorted(((i, f, low[c]) for (i, _), f, c in zip(rows, fps, comp)), key=str)
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, component_id int").repartition(4)
    for rows_in_bucket in (1024, 2):  # 2: every bucket is dealt out in parts
        got = simhash.near_duplicates(d, bucket_rows=rows_in_bucket).collect()
        assert sorted(((r["doc_id"], r["fp"] % 2 ** 64, r["component_id"]) for r in got), key=str) == want
    kept = simhash.keep_one(d)
    assert kept.columns == d.columns
    out = kept.collect()
    assert len(out) == len(set(comp))
    by_text = {(i, t): c for (i, t), c in zip(rows, comp)}
    assert len({by_text[r["doc_id"], r["text"]] for r in out}) == len(out)
    assert all(r["doc_id"] == low[by_text[r["doc_id"], r["text"]]] for r in out)
    assert simhash.near_duplicates(d.limit(0)).count() == 0 and simhash.keep_one(d.limit(0)).count() == 0


def test_links_lose_none(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2 ** 63, 30, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    fps = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(12):
            x = s
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    d = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in fps], "fp long")
    want = brute_components([(x, "") for x in fps], fps)
    groups = {c: {f for f, x in zip(fps, want) if x == c} for c in want}
    for blocks in (5, 6, 8):
        label = {r["node"] % 2 ** 64: r["label"] for r in simhash.components(simhash.link_fingerprints(d, 3, blocks, 16)).collect()}
        by = {}
        for f in fps:
            by.setdefault(label.get(f, int(np.uint64(f).astype(np.int64))), set()).add(f)
        assert sorted(map(sorted, by.values())) == sorted(map(sorted, groups.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(-5, -9), (-9, 300), (300, 299)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["label"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, **{i: -9 for i in (-5, 299, 300)}}


def test_long_texts_hash_in_chunks(monkeypatch):
    from valora.llm import common
    real = common.word_chunks
    monkeypatch.setattr(simhash, "word_chunks", lambda data, keep: real(data, keep, 40))
    rng = random.Random(0)
    for n in (1, 2, 3, 50, 400):
        text = " ".join(rng.choices(["ab", "cde", "f", "x" * 60], k=n))
        assert simhash.simhash(text.encode(), 3) == brute_simhash(text)


# ---- the pipeline

def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    rng = random.Random(8)
    vocab = [f"wo{i}" for i in range(300)]
    good = [" ".join(rng.choices(vocab, k=rng.randrange(40, 90))) for _ in range(160)]
    bad = [" ".join(w + "&&&" for w in rng.choices(vocab, k=50)) for _ in range(60)]
    item = " ".join(rng.choices(vocab, k=20))
    texts = good + bad
    texts[10] += ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end'
    texts[20] += " " + item + " tail"
    texts += [good[0], good[0].upper(), good[1] + "\n"]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", len(texts[0])), (None, good[3], None, None, None)]
    for name, rows, schema in (
            ("documents", [(*r, 1.0) for r in docs], "doc_id long, text string, lang string, source string, n_chars long, score double"),
            ("labels", [(i, int(i < 160), 0) for i in range(220)], "doc_id long, quality int, toxic int"),
            ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    frames = [spark.read.parquet(f"{tmp_path}/documents.parquet")]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frames[-1], str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"{tmp_path}/{i}"))
    ids = [sorted((r["doc_id"] for r in f.collect()), key=str) for f in frames]
    assert all(f.columns == frames[0].columns for f in frames[:5])
    assert len([i for i in ids[1] if i is None or i < 160 or i >= 220]) >= 160 and not [i for i in ids[1] if i is not None and 160 <= i < 220]
    assert ids[2] == sorted((i for i in range(160)), key=str)  # one of each group, the smallest id
    assert ids[3] == [i for i in ids[2] if i != 20] and ids[4] == ids[3]
    masked = {r["doc_id"]: r for r in frames[4].collect()}
    assert "04dbebab" not in masked[10]["text"] and masked[10]["n_chars"] == len(masked[10]["text"])
    assert all(masked[i]["text"] == texts[i] for i in ids[4] if i != 10)
    assert sorted({r["doc_id"] for r in frames[5].collect()}, key=str) == ids[4]
    assert sorted(map(str, cp.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(
        map(str, frames[5].drop("sequence_id", "offset").collect()))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"),
                         ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
