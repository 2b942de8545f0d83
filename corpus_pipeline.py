"""Corpus cleaning pipeline over ``documents``: each stage reads what the one
before it kept, as Parquet, and calls one operator of ``valora.llm``.

1. quality classifier: documents that score below the threshold go;
2. SimHash near-duplicates: of each component the row of the smallest id stays;
3. benchmark decontamination: documents that hold a window of a test item go;
4. secret scan: secrets are replaced in the text, all documents stay;
5. best-fit packing: the rest as pieces of sequences of at most 2048 tokens.

Nulls: a null text is a text without words, a null id is never preferred among
near-duplicates.  Repeated rows are copies of which one stays.  An empty table
goes through as an empty table.  Further columns of ``documents`` are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.llm import decontam, packing, quality, secret_scan, simhash
from valora.llm.common import scratch_path, table
from valora.llm.queries import QUALITY_THRESHOLD, TOKENIZER, fold
from valora.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels), QUALITY_THRESHOLD)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_scan.mask_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    packed = packing.pack(docs, TOKENIZER)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"),
                         "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL expresses the classifier, the fingerprints or the tokenizer; a test
#: holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
