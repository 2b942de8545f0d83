import numpy as np

from valora.operators import linear
from valora.streaming.scoring import score_stream

SF = "/root/testdata/sf0.001"


def test_stream_scoring_equals_batch_scoring(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_size", "p_retailprice")
    g = linear.gram(part, ["p_size"], "p_retailprice")
    m = linear.fit_ridge(g, 1.0)
    stream = (spark.readStream.schema(spark.read.parquet(f"{SF}/part.parquet").schema)
              .parquet(f"{SF}/part[.]parquet"))
    got = score_stream(stream, lambda df: m.transform(df).select("p_partkey", "prediction"))
    batch = {r.p_partkey: r.prediction for r in m.transform(part).collect()}
    rows = got.collect()
    assert len(rows) == len(batch)
    assert all(np.isclose(r.prediction, batch[r.p_partkey]) for r in rows)
