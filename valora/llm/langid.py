"""Language identification: multinomial naive Bayes over hashed character
n-grams.

Training counts the n-grams of every labelled text by language (one pass; the
count matrix is added up in Spark by blocks).  The log-probability matrix,
languages by buckets, is broadcast: its size is fixed by the number of buckets
and checked for the number of languages.  Scoring takes documents in batches:
their n-grams form sparse rows, and a row's log-likelihoods are sums of columns
of the matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valora.llm.common import padded, raw, spread, sum_arrays

#: Bytes: A-Z lowered; all ASCII but letters is a blank.
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def grams(data: bytes, sizes: tuple[int, ...], buckets: int) -> np.ndarray:
    """Hashed n-grams of the UTF-8 bytes (n of ``sizes``), runs of blanks as one,
    one blank around the text; those of blanks only are left out."""
    codes = _LOWER[np.frombuffer(data, np.uint8)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint8)
    blank = codes == 32
    codes = codes[~(blank & np.r_[False, blank[:-1]])].astype(np.uint32)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    out = []
    for n in sizes:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ codes[i:len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append(h % np.uint32(buckets))
    return np.concatenate(out).astype(np.int64)


def _pieces(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    for at in range(0, len(data), size):
        yield data[at:at + size]


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, float32
    prior: np.ndarray
    sizes: tuple[int, ...]

    def predict(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, probability); texts in sparse rows of n-grams."""
        total = np.tile(self.prior, (len(texts), 1))
        lengths = np.zeros(len(texts))
        rows: list[int] = []
        parts: list[np.ndarray] = []
        held = 0

        def add() -> None:
            nonlocal rows, parts, held
            if parts:
                starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
                sums = np.add.reduceat(self.log_prob[np.concatenate(parts)], starts, axis=0, dtype=np.float64)
                np.add.at(total, rows, sums)
                rows, parts, held = [], [], 0

        for row, text in enumerate(texts):
            for piece in _pieces(text or b""):
                ids = grams(piece, self.sizes, len(self.log_prob))
                if len(ids):
                    rows.append(row)
                    parts.append(ids)
                    held += len(ids)
                    lengths[row] += len(ids)
                if held >= 1 << 18:
                    add()
        add()
        best = total.argmax(axis=1)
        # n-grams overlap, so evidence counts by one size of n-gram, not by all
        level = (total - total.max(axis=1, keepdims=True)) / len(self.sizes)
        share = np.exp(level)
        return best, (share / share.sum(axis=1, keepdims=True)).max(axis=1)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sizes: tuple[int, ...] = (1, 2, 3, 4),
          buckets: int = 1 << 16, alpha: float = 0.1, most_bytes: int = 64 << 20) -> LanguageModel:
    """Counts over all rows of ``docs`` with a language; null texts count nothing.
    The matrix may take ``most_bytes``: with more languages, buckets are halved
    until it fits.  Without languages the model has none."""
    known = docs.filter(F.col(f"`{lang_col}`").isNotNull())
    per_lang = known.groupBy(F.col(f"`{lang_col}`").alias("l")).count().orderBy("l").collect()
    languages = [r["l"] for r in per_lang]
    while buckets > 256 and len(languages) * buckets * 8 > most_bytes:
        buckets //= 2
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> dict[str, np.ndarray]:
        total = np.zeros((len(languages), buckets))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = total[place[lang]]
                for piece in _pieces(text.as_py() or b""):
                    ids = grams(piece, sizes, buckets)
                    if len(ids) * 2 > buckets:
                        own += np.bincount(ids, minlength=buckets)
                    else:
                        np.add.at(own, ids, 1)
        return {"n": total}

    got = sum_arrays(spread(known.select(F.col(f"`{lang_col}`").alias("l"), raw(text_col).alias("t"))), count)
    n = padded(got, "n", (len(languages), buckets)) + alpha
    log_prob = np.log(n / n.sum(axis=1, keepdims=True)).T
    rows = np.array([r["count"] for r in per_lang], float) + 1
    return LanguageModel(languages, np.ascontiguousarray(log_prob, np.float32), np.log(rows / rows.sum()), tuple(sizes))


_ANSWER = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def predict_udf(model: LanguageModel, spark, unknown: str = "und"):
    """Column function of (UTF-8 bytes, has a letter) to language and score."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array, letters: pa.Array) -> pa.Array:
        out: list[dict] = []
        for i in range(0, len(texts), 512):
            part = [t.as_py() for t in texts.slice(i, 512)]
            some = letters.slice(i, 512).to_pylist()
            if not sent.value.languages:
                out += [{"lang": unknown, "score": 0.0}] * len(part)
                continue
            best, score = sent.value.predict(part)
            out += [{"lang": sent.value.languages[b], "score": float(s)} if t is not None and ok else
                    {"lang": unknown, "score": 0.0} for t, ok, b, s in zip(part, some, best, score, strict=True)]
        return pa.array(out, _ANSWER)
    return predict


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` of each row: the likeliest learned
    language (ties to the first by name) and its probability.  ``und`` and 0 for a
    null text, one without a letter, or a model without languages.  Repeated rows
    keep one row each; a null id stays null; other columns aren't read; an empty
    table gives no rows."""
    text = F.col(f"`{text_col}`")
    letter = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    found = predict_udf(model, docs.sparkSession)(raw(text_col), letter)
    return docs.select(F.col(f"`{id_col}`"), found.alias("f")).select(
        F.col(f"`{id_col}`"), F.col("f.lang").alias("lang_pred"), F.col("f.score").alias("score"))
