"""What a step stages, holds and passes on, which its result doesn't show."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from valora import session
from valora.operators import boosting
from valora.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    day = F.timestamp_add("DAY", F.col("id") % 900, F.lit("1994-01-01").cast("timestamp"))
    flag = F.element_at(F.array(*map(F.lit, "ANR")), (F.col("id") % 3 + 1).cast("int"))
    spark.range(600).select(
        (F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") % 30).alias("l_partkey"), (F.col("id") % 7).alias("l_suppkey"),
        (F.col("id") % 4).cast("int").alias("l_linenumber"), (F.col("id") % 47 + 1.0).alias("l_quantity"),
        (F.col("id") * 37 % 601 + 900.0).alias("l_extendedprice"), (F.col("id") % 11 / 100).alias("l_discount"),
        (F.col("id") % 9 / 100).alias("l_tax"), flag.alias("l_returnflag"), day.alias("l_shipdate")).write.parquet(f"{d}/lineitem.parquet")
    spark.range(30).select(F.col("id").alias("p_partkey"), F.concat(F.lit("b"), F.col("id") % 5).alias("p_brand"),
                           F.concat(F.lit("t"), F.col("id") % 4).alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size")
                           ).write.parquet(f"{d}/part.parquet")
    spark.range(150).select(F.col("id").alias("o_orderkey"), F.lit("1993-05-05").cast("timestamp").alias("o_orderdate"),
                            F.concat(F.col("id") % 5 + 1, F.lit("-X")).alias("o_orderpriority")).write.parquet(f"{d}/orders.parquet")
    return d


@pytest.mark.parametrize("name", ["outlier_eda", "correlation_eda"])
def test_eda_scans_one_staged_join(spark, tables, monkeypatch, name):
    staged = []
    real = session.stage_table
    monkeypatch.setattr(session, "stage_table", lambda df, *a: staged.append(df.columns) or real(df, *a))
    assert catalog.QUERIES[name](spark, tables).count() > 0
    assert len(staged) == 1 and "Id" not in staged[0] and "HotelValue" in staged[0]


def test_rows_are_routed_a_level_at_a_time(monkeypatch):
    """A tree of many splits costs as many steps as it has levels."""
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 64, (500, 4)).astype(np.uint8)
    splits, leaves, nodes = [], [0], 1
    for level in range(6):
        new = []
        for node in leaves[:9]:
            splits.append((node, int(rng.integers(4)), int(rng.integers(20, 44)), nodes))
            new += [nodes, nodes + 1]
            nodes += 2
        leaves = new
    want = np.zeros(500, np.int64)
    for node, f, cut, left in splits:
        here = want == node
        want[here] = left + (codes[here, f] > cut)
    monkeypatch.setattr(boosting.NumpyRows, "split", lambda *a: pytest.fail("a step for one split"))
    assert (boosting._route(codes, splits, nodes) == want).all()
    assert (boosting._route(codes, [], 1) == 0).all()
    column = pa.array([c.tobytes() for c in codes], pa.binary())
    assert (boosting._codes(column[7:90]) == codes[7:90]).all() and len(boosting._codes(column[3:3])) == 0


def test_generated_methods_stay_within_what_the_jvm_compiles(spark):
    from valora.session import ship_package
    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        for was, now in (("65535", "8000"), ("4000", "4000")):
            spark.conf.set(limit, was)
            ship_package(spark)
            assert spark.conf.get(limit) == now
    finally:
        spark.conf.set(limit, before)


def test_ordinal_lookup_needs_no_map_value(spark):
    from valora.functions.exprs import ordinal_expr
    df = spark.createDataFrame([("Ex",), ("ZZ",), (None,), ("ta",), ("None",)], "q string")
    cols = [ordinal_expr("q", {"Ex": 5, "TA": 3, "None": 1}, default=-1.0).alias("a"),
            ordinal_expr("q", {"TA": 3}, upper=True).alias("b"), ordinal_expr("q", {}, default=2.0).alias("c")]
    got = df.select(*cols)
    assert "map(" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [(5.0, 0.0, 2.0), (-1.0, 0.0, 2.0), (1.0, 0.0, 2.0), (-1.0, 3.0, 2.0), (1.0, 0.0, 2.0)]
