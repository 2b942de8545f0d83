"""Table sources and prediction sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text tokens pandas' CSV reader turns into a missing value
# (its default na_values list), matched as they stand.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.globStatus(jpath)) if any(ch in path for ch in "*?[") else fs.exists(jpath)


def read_table(spark: SparkSession, paths: str | Sequence[str], schema=None,
               fmt: str | None = None, null_tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """Read the first of ``paths`` that exists (S1).  CSV gets a header, an
    optional explicit schema (no inference pass when given) and the null
    tokens normalised (S2); parquet/orc/json are read as is."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if not _exists(spark, p):
            continue
        kind = fmt or ("csv" if p.endswith(".csv") else "parquet" if p.endswith(".parquet")
                       else "json" if p.endswith(".json") else "orc" if p.endswith(".orc") else "parquet")
        if kind == "csv":
            text = normalize_nulls(spark.read.option("header", True).csv(p), null_tokens)
            return _typed(text, schema)
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.format(kind).load(p)
    raise FileNotFoundError(f"none of {paths} exists")


def _typed(text: DataFrame, schema=None) -> DataFrame:
    """Cast a table of strings, its null tokens gone already.  With ``schema``
    (names and types) columns are cast to it by place; else a column is a bigint
    or a double where all its cells are such numbers (one aggregate decides for
    all columns), or a string."""
    if schema is not None:
        want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        return text.select(*[F.col(f"`{c}`").try_cast(f.dataType).alias(f.name)
                             for c, f in zip(text.columns, want.fields, strict=True)])
    cells = [F.col(f"`{c}`") for c in text.columns]
    counts = text.agg(*[F.count(e).alias(f"n{i}") for i, e in enumerate(cells)],
                      *[F.count(e.try_cast(k)).alias(f"{k}{i}") for i, e in enumerate(cells)
                        for k in ("bigint", "double")]).first()
    out = []
    for i, (c, e) in enumerate(zip(text.columns, cells)):
        numbers = [k for k in ("bigint", "double") if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]]
        kind = numbers[0] if numbers else "string"
        out.append(e.cast(kind).alias(c))
    return text.select(*out)


def normalize_nulls(df: DataFrame, tokens: Iterable[str] = NULL_TOKENS) -> DataFrame:
    """String cells that are a null token become null, and so do NaN cells of
    number columns (S2)."""
    tokens = list(tokens)
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType):
            out.append(F.when(F.col(f.name).isin(tokens), F.lit(None).cast("string"))
                       .otherwise(F.col(f.name)).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def write_predictions(df: DataFrame, path: str, key: str = "Id", target: str = "HotelValue",
                      fmt: str = "csv", single_file: bool = False, mode: str = "overwrite") -> None:
    """Write ``key, target`` with a header (S3).  Parallel part files by
    default; one file only on request (``coalesce(1)``: small outputs only)."""
    out = df.select(key, target)
    if single_file:
        out = out.coalesce(1)
    w = out.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def preview(df: DataFrame, n: int = 5, by: str | Sequence[str] = "Id") -> DataFrame:
    """First ``n`` rows in an explicit order (S4; limit is the feature)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.orderBy(*by).limit(n)


def shape_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row and column counts before/after a cleaning step (S5), one row."""
    tagged = (before.select(F.lit(1).alias("__b"), F.lit(0).alias("__a"))
              .unionByName(after.select(F.lit(0).alias("__b"), F.lit(1).alias("__a"))))
    return (tagged.agg(F.coalesce(F.sum("__b"), F.lit(0)).cast("long").alias("rows_before"),
                       F.coalesce(F.sum("__a"), F.lit(0)).cast("long").alias("rows_after"))
            .select("rows_before", "rows_after",
                    (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"),
                    F.lit(len(before.columns)).cast("int").alias("cols_before"),
                    F.lit(len(after.columns)).cast("int").alias("cols_after")))
