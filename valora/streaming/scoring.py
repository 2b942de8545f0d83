"""G1 over a stream: a model fitted in batch scores a ``readStream`` source
micro-batch by micro-batch; results land in a parquet table under the shared
checkpoint folder (never a driver-memory sink)."""

from __future__ import annotations


from pyspark.sql import DataFrame

from ..session import owned_path


def score_stream(stream: DataFrame, scorer, out_dir: str | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Apply ``scorer`` (a DataFrame -> DataFrame projection) to every row of
    a streaming source, run until the available input is processed, and
    return the written table as a batch DataFrame."""
    spark = stream.sparkSession
    out_dir = out_dir or owned_path(spark, "stream-out")
    q = (scorer(stream).writeStream.format("parquet")
         .option("path", out_dir)
         .option("checkpointLocation", owned_path(spark, "stream-ckpt"))
         .outputMode("append")
         .trigger(availableNow=True)
         .start())
    q.awaitTermination()
    return spark.read.parquet(out_dir)
