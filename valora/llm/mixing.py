"""Mixing sources to target weights by a low-discrepancy schedule.

Every source has a weight and a target: its share by weight of the words that
the mix takes, at most ``most`` times its own size, the excess shared by weight
among the rest until no target is above that.  The mix is a row of slots.  Slot
``i`` is the van der Corput point of ``i`` (its bits reversed) mapped through
the cumulative targets, so that every stretch of slots holds the sources close
to their targets.  The slots of a source are ranked, its documents are shuffled
by a hash and laid end to end (again from the first when they run out), and the
stretch up to the source's target is cut into as many blocks of equal words as
it has slots: the block of rank ``k`` goes to the slot of rank ``k``, by a join.

DataFrame functions only.  Running sums and ranks never take a whole source
into one task: they are sums inside buckets, about the square root of all rows
many, and sums over the buckets.  Rows that agree in id, source and size are
one row with a count until the blocks are cut, so copies don't gather either.
The driver holds a few numbers a round of resharing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valora.functions.ranking import global_index
from valora.llm.common import cut

#: Points of the schedule are whole numbers below two to this power.
POINT_BITS = 40
#: Rows that agree in id, source and size beyond this many are dealt out again before they become single rows.
COPIES_A_ROW = 1024
_HASH_BITS = 32


@dataclass(frozen=True)
class Mix:
    """``sources``: source, weight, source_size, target, take (whole words), slots.
    ``documents``: one row per document with its source's columns.
    ``pieces``: slot, doc_id, source, at, copy, round, start, end: the words of the
    document (from ``start``, without ``end``) that the slot takes; ``at`` is the
    document's place among its source's words, ``round`` counts the repeats, and
    pieces of a slot go by ``round`` and ``at``."""

    sources: DataFrame
    documents: DataFrame
    pieces: DataFrame
    _joined: DataFrame

    def taken(self) -> DataFrame:
        """One row per document: doc_id, source, size, source_size, target, taken."""
        words = F.sum(F.when(F.col("slot").isNotNull(), F.col("stop") - F.col("start")).otherwise(0))
        return (self._joined.groupBy("key", "source", "at", "copy", "doc_id", "size", "source_size", "target")
                .agg(words.cast("long").alias("taken"))
                .select("doc_id", "source", "size", "source_size", "target", "taken"))


def _bits(n: int) -> int:
    """The least whole number of bits that ``n`` different values need."""
    return max(0, int(n) - 1).bit_length()


def running(df: DataFrame, value: Column, key: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the earlier rows of the same
    ``key`` in the order (``bucket``, ``order``).  A task holds the rows of one
    bucket, or one row for each bucket of a key.  ``df`` is read twice."""
    df = df.withColumn("__v", value)
    upto = (Window.unboundedPreceding, -1)
    base = (df.groupBy(*key, bucket).agg(F.sum("__v").alias("__t"))
            .withColumn("__b", F.coalesce(F.sum("__t").over(Window.partitionBy(*key).orderBy(bucket).rowsBetween(*upto)), F.lit(0)))
            .drop("__t"))
    inner = Window.partitionBy(*key, bucket).orderBy(*order).rowsBetween(*upto)
    return (df.withColumn("__w", F.coalesce(F.sum("__v").over(inner), F.lit(0)))
            .join(base, [*key, bucket])
            .withColumn(name, F.col("__b") + F.col("__w")).drop("__v", "__b", "__w"))


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``sources`` (weight, source_size) with ``target`` (double).  A round is one
    aggregate: targets that would be above their bound stop there, what is left
    is shared by weight among the others; it ends when none is new."""
    bound = F.col("source_size") * most
    row = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    total = share * (row["size"] or 0)
    rate, seen = total / (row["weight"] or 1), -1
    while True:
        full = bound <= F.col("weight") * F.lit(rate)
        got = sources.agg(F.count_if(full).alias("n"), F.sum(F.when(full, bound)).alias("held"),
                          F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if got["n"] == seen:
            break
        seen = got["n"]
        rate = (total - (got["held"] or 0)) / got["open"] if got["open"] else math.inf
    return sources.withColumn("target", F.when(bound <= F.col("weight") * F.lit(rate), bound.cast("double"))
                              .otherwise(F.col("weight") * F.lit(rate)))


def _schedule(sources: DataFrame, block: int) -> DataFrame:
    """(key, rank, slot): the slots of the mix, ranked by source."""
    row = sources.agg(F.sum("take").alias("take"), F.count("*").alias("n")).first()
    total = int(row["take"] or 0)
    count = min(-(-total // block), 1 << POINT_BITS)
    grid = POINT_BITS - min(POINT_BITS, _bits(row["n"]) + 2)
    scale = 1 << POINT_BITS
    ends = running(sources.withColumn("chunk", F.floor(F.col("index") / 4096)), F.col("take"), [], "chunk", ["index"], "before")

    def point(x: Column) -> Column:
        return F.floor(x.cast("double") / F.lit(float(max(total, 1))) * scale).cast("long")

    spans = (ends.filter("take > 0").select("key", point(F.col("before")).alias("low"), point(F.col("before") + F.col("take")).alias("high"))
             .filter("high > low")
             .withColumn("cell", F.explode(F.sequence(F.shiftright("low", grid), F.shiftright(F.col("high") - 1, grid)))))
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0")), 2, 10).cast("long")
    slots = (sources.sparkSession.range(count).withColumnRenamed("id", "slot").withColumn("point", reversed_bits)
             .withColumn("cell", F.shiftright("point", grid)))
    dealt = slots.join(spans, "cell").filter("point >= low AND point < high").select("key", "slot")
    # a source whose share is below one slot may get none: its words follow at the end
    own = sources.filter("take > 0").join(dealt.select("key").distinct(), "key", "left_anti")
    dealt = cut(dealt.unionByName(own.select("key", (F.lit(count) + F.col("index")).alias("slot"))))
    span = (_bits(max(count, 1)) + 1) // 2
    return cut(running(dealt.withColumn("part", F.shiftright("slot", span)), F.lit(1).cast("long"), ["key"], "part", ["slot"], "rank")
               .select("key", "rank", "slot"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, block: int = 1024,
        seed: int = 42) -> Mix:
    """Mix ``docs`` by source.  ``weights`` go to the sources by code point, null
    last, again from the first when they run out; the mix takes ``share`` times
    all words, from a source at most ``most`` times its words; ``block`` is the
    words a slot takes, as near as the number of slots allows.

    A word is a run without ASCII white space.  A null or blank text has size zero
    and is never taken; a null source is a source; a null id is an id like any
    other; repeated rows are documents of their own.  Other columns are not read,
    so their names don't matter.  An empty table gives no rows.  The same table
    gives the same mix, whatever its partitions: order is by md5 of id and
    ``seed``, then id and size.
    """
    spark = docs.sparkSession
    source = F.col(f"`{source_col}`").cast("string")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    doc = F.col(f"`{id_col}`")
    order = F.md5(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    classes = cut(
        docs.select(F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("key"),
                    source.alias("source"), doc.alias("doc_id"), size.alias("size"), order.alias("order"))
        .groupBy("key", "source", "doc_id", "size", "order").agg(F.count("*").alias("copies")))
    words = F.col("size") * F.col("copies")

    sources = classes.groupBy("key").agg(F.first("source").alias("source"), F.sum(words).alias("source_size"))
    sources = global_index(sources, "key", "index")
    cycle = F.array(*(F.lit(int(w)) for w in weights))
    sources = cut(sources.withColumn("weight", F.element_at(cycle, (F.col("index") % len(weights)).cast("int") + 1)))
    sources = cut(targets(sources, share, most).withColumn("take", F.floor("target").cast("long")))
    schedule = _schedule(sources, block)
    slots = schedule.groupBy("key").agg(F.count("*").alias("slots"))
    sources = cut(sources.join(slots, "key", "left").withColumn("slots", F.coalesce("slots", F.lit(0))))

    facts = classes.agg(F.count("*").alias("n"), F.max("copies").alias("copies")).first()
    bits = min(_HASH_BITS, (_bits(facts["n"]) + 1) // 2)
    bucket = F.shiftright(F.conv(F.substring("order", 1, _HASH_BITS // 4), 16, 10).cast("long"), _HASH_BITS - bits)
    placed = running(classes.withColumn("bucket", bucket), words, ["key"], "bucket", ["order", "doc_id", "size"], "at")
    # source columns by (source, bucket), which no source overfills
    held = (classes.select("key", bucket.alias("bucket")).distinct()
            .join(sources.select("key", "source_size", "target", "take", "slots"), "key"))
    rows = placed.join(held, ["key", "bucket"])
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("copies") - 1, F.lit(COPIES_A_ROW))))
    if (facts["copies"] or 0) > COPIES_A_ROW:
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "key", "order", "first")
    last = F.least(F.col("first") + COPIES_A_ROW, F.col("copies")) - 1
    rows = (rows.withColumn("copy", F.explode(F.sequence("first", last)))
            .withColumn("at", F.col("at") + F.col("copy") * F.col("size")).drop("first", "copies", "order"))

    rounds = F.when((F.col("size") > 0) & (F.col("at") < F.col("take")),
                    F.sequence(F.lit(0).cast("long"), F.expr("(take - 1 - at) div source_size")))
    parts = (rows.withColumn("round", F.explode_outer(rounds))
             .withColumn("from", F.col("round") * F.col("source_size") + F.col("at"))
             .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take")))
             .withColumn("q", F.expr("take div greatest(slots, 1)")).withColumn("r", F.expr("take % greatest(slots, 1)")))

    def at_slot(x: str) -> Column:  # the first r blocks have q + 1 words, the others q
        return F.expr(f"CASE WHEN {x} < r * (q + 1) THEN {x} div (q + 1) ELSE r + ({x} - r * (q + 1)) div greatest(q, 1) END")

    def begin(k: Column) -> Column:
        return k * F.col("q") + F.least(k, F.col("r"))

    ranks = F.when(F.col("to") > F.col("from"), F.sequence(at_slot("from"), at_slot("(to - 1)")))
    parts = (parts.withColumn("k", F.explode_outer(ranks))
             .withColumn("start", F.greatest("from", begin(F.col("k"))) - F.col("from"))
             .withColumn("stop", F.least(F.col("to"), begin(F.col("k") + 1)) - F.col("from"))
             # rows without words meet no slot and stay spread over the buckets
             .withColumn("rank", F.coalesce(F.col("k"), -1 - F.col("bucket"))))
    joined = parts.join(schedule, ["key", "rank"], "left")
    names = ["key", "source", "at", "copy", "doc_id", "size", "source_size", "target"]
    joined = joined.select(*names, "round", "slot", "start", "stop")
    pieces = joined.filter("slot IS NOT NULL").select(
        "slot", "doc_id", "source", "at", "copy", "round", "start", F.col("stop").alias("end"))
    out = sources.select("source", "weight", "source_size", "target", "take", "slots")
    return Mix(out, rows.select("doc_id", "source", "size", "source_size", "target", "at", "copy"), pieces, joined)
