"""Shared helpers: reading tables, raw-byte text columns, reliable staging and
data-parallel training rounds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valora.session import ensure_checkpoint_dir, owned_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(col: str):
    """A string column as its UTF-8 bytes: what byte-level lexers read, without
    decoding and encoding every text on the way to Python."""
    return F.col(f"`{col}`").cast("binary")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, removed with the
    application."""
    return owned_path(spark, name)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later passes read files of the shared folder; Spark
    removes them with the frame where its cleaner is on."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least one task a core.  The number of splits is read from
    the physical scan; large tables keep theirs."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df


def has_rows(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def word_chunks(data: bytes, keep: int, size: int = 1 << 22) -> Iterator[list[bytes]]:
    """The whitespace-separated words of ``data``, a bounded number at a time:
    cut at white space about every ``size`` bytes, each list beginning with the
    last ``keep`` words of the one before."""
    if len(data) <= size:
        yield data.split()
        return
    tail: list[bytes] = []
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = tail + data[at:end].split()
        at = end
        yield words
        tail = words[len(words) - keep:] if keep and len(words) >= keep else (words if keep else [])


def sum_arrays(df: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray]],
               block: int = 4096) -> dict[str, np.ndarray]:
    """Data-parallel sum.  ``task`` turns a partition into named float64 arrays of
    a fixed size; they travel in blocks of ``block`` numbers, and the blocks of
    all tasks are added up in Spark by (name, block), so no task and not the
    driver holds more than one copy of the result."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, values in task(batches).items():
            flat = np.ascontiguousarray(values, np.float64).ravel()
            for b in range(0, len(flat), block):
                part = flat[b:b + block]
                if part.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name]), pa.array([b], pa.int64()),
                         pa.array([part.tobytes()], pa.binary())], ["name", "at", "part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(part, np.float64)
                if (name, at) in have:
                    have[name, at] += x
                else:
                    have[name, at] = x.copy()
        for (name, at), x in have.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([at], pa.int64()), pa.array([x.tobytes()], pa.binary())],
                ["name", "at", "part"])

    schema = "name string, at long, part binary"
    parts = df.mapInArrow(emit, schema)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (parts.repartition(n, "name", "at").mapInArrow(add, schema)
            .orderBy("name", "at").collect())
    out: dict[str, list[tuple[int, np.ndarray]]] = {}
    for r in rows:
        out.setdefault(r["name"], []).append((r["at"], np.frombuffer(r["part"], np.float64)))
    return {k: _joined(v) for k, v in out.items()}


def _joined(parts: list[tuple[int, np.ndarray]]) -> np.ndarray:
    out = np.zeros(max(at + len(x) for at, x in parts))
    for at, x in parts:
        out[at:at + len(x)] = x
    return out


def padded(values: dict[str, np.ndarray], name: str, shape: tuple[int, ...]) -> np.ndarray:
    """A named result of :func:`sum_arrays` in its shape (blocks that are all
    zero aren't sent)."""
    flat = np.zeros(int(np.prod(shape)))
    got = values.get(name, np.zeros(0))
    flat[:len(got)] = got
    return flat.reshape(shape)
