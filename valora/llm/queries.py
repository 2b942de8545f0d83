"""Registered queries of the operators, each over its whole table with
production parameters, in the form its result is compared in; and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm import (
    alignment, decontam, langid, license_scan, lm_score, mixing, packing, quality, secret_scan, simhash, spelling, topk, warc,
)
from valora.llm.common import scratch_path, table

#: Scores below this are rejected.
QUALITY_THRESHOLD = 0.3
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALIGNED = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def fold(col: str, folds: int):
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % folds


def digest(items):
    """Lower-case hex SHA-256 of an array of strings, comma-joined."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        digest(F.array_sort("items")).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), k=5, scale=256.0)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.find_licenses(table(spark, sf_dir, "documents"))
    best = F.array_max(F.transform("licenses", lambda x: x["coverage"]))
    shown = F.transform("licenses", lambda x: F.concat_ws(
        ":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"),
                        F.array_join(shown, ",").alias("licenses"), F.coalesce(best, F.lit(0.0)).alias("coverage"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs.filter(~held_out).select("text", "lang"))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    model = quality.train(docs, labels)
    scored = quality.score_quality(docs, model)
    return scored.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, least=100)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.train_and_score(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def shown(spans):
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))

    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        digest(shown(F.filter("spans", lambda s: s["kind"] != "literal"))).alias("base_sha256"),
        F.array_join(shown(F.col("spans")), ",").alias("spans"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), every=199, least=6, times=5, ratio=5)


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2)
    return mixed.taken().select("doc_id", "size", "source_size", "target", "taken")


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), *ALIGNED).documents


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontaminate, op2_topk, op3_licenses, op4_langid, op5_quality, op6_warc, op7_pack, op8_simhash,
        op9_lm_score, op10_secrets, op11_spelling, op12_mix, op13_align)
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": r"""
WITH words AS (
    SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM documents),
item AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
    FROM benchmark),
win AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
widths AS (SELECT DISTINCT k FROM win),
gram AS (
    SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i,
           unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS s
    FROM words, widths WHERE len(w) >= k),
found AS (SELECT doc_id, i, k, item_id FROM gram JOIN win USING (k, s)),
hits AS (
    SELECT doc_id, count(DISTINCT pos) AS n FROM (
        SELECT doc_id, unnest(range(i, i + k)) AS pos FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit,
       coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256,
       coalesce(hits.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op2_topk": """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
    "op6_warc": """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND lead <> page_id THEN lead END AS refers_to
FROM f
""",
    "op12_mix": r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
           md5(coalesce(doc_id::VARCHAR, '') || ':42') AS ord
    FROM documents),
s AS (
    SELECT source, sum(size)::BIGINT AS size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
    FROM d GROUP BY source),
r AS (
    SELECT 1.5::DOUBLE * sum(size) OVER () AS total, sum(w) OVER () AS all_w,
           coalesce(sum(2 * size) OVER (ORDER BY 2 * size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
           coalesce(sum(w) OVER (ORDER BY 2 * size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_w
    FROM s),
t AS (
    SELECT source, size, least(2.0::DOUBLE * size, w * (SELECT max((total - held) / (all_w - held_w)::DOUBLE) FROM r)) AS target
    FROM s),
o AS (
    SELECT d.*, t.size AS source_size, t.target, floor(t.target)::BIGINT AS take,
           coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, d.size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(pos + size, take) - pos)
        + greatest(0, least(source_size + pos + size, take) - (source_size + pos)))::BIGINT AS taken
FROM o
""",
}
