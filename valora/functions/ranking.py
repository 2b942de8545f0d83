"""Distributed global row positions (no single-partition window)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

_LOW_BITS = 33  # monotonically_increasing_id: partition id << 33 | row number


def global_index(df: DataFrame, order_cols, name: str = "idx") -> DataFrame:
    """Add ``name`` = 0-based position of each row in the total order of
    ``order_cols`` (give a unique key among them for a deterministic order).

    A ``Window.orderBy`` without ``partitionBy`` moves every row into one task.
    Here the sort is range-partitioned across the cluster; each row's position
    inside its partition comes from ``monotonically_increasing_id``; a table of
    one count per partition gives the offsets.  The tagged rows are
    checkpointed so that a retried task cannot renumber them."""
    order_cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    tagged = (df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
              .withColumn("__gi_mid", F.monotonically_increasing_id()))
    tagged = cut_lineage(tagged)
    tagged = (tagged.withColumn("__gi_pid", F.shiftright("__gi_mid", _LOW_BITS))
              .withColumn("__gi_pos", F.col("__gi_mid").bitwiseAND(F.lit((1 << _LOW_BITS) - 1))))
    counts = tagged.groupBy("__gi_pid").agg(F.count(F.lit(1)).alias("__gi_c"))
    # one row per partition: bounded by the partition count, safe to broadcast
    offsets = counts.select("__gi_pid", F.coalesce(F.sum("__gi_c").over(
        Window.orderBy("__gi_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__gi_off"))
    return (tagged.join(F.broadcast(offsets), on="__gi_pid")
            .withColumn(name, (F.col("__gi_off") + F.col("__gi_pos")).cast("long"))
            .drop("__gi_mid", "__gi_pid", "__gi_pos", "__gi_off"))
