import os
import tempfile

from pyspark.sql import functions as F

from valora.sources import preview, read_table, shape_report, write_predictions


def test_csv_fallback_null_tokens_and_sink(spark):
    d = tempfile.mkdtemp(prefix="valora-src-", dir="/tmp")
    path = os.path.join(d, "train.csv")
    with open(path, "w") as f:
        f.write("Id,HotelValue,KitchenQuality,LandArea\n1,100.5,Gd,NA\n2,200.0,None,3.0\n3,300.0,TA,\n")
    df = read_table(spark, [os.path.join(d, "nested", "train.csv"), path])  # first path is missing
    rows = df.orderBy("Id").collect()
    assert [r.KitchenQuality for r in rows] == ["Gd", None, "TA"]  # 'None' text -> null
    assert rows[0].LandArea is None and rows[1].LandArea == 3.0  # 'NA' and '' -> null
    assert dict(df.dtypes)["HotelValue"] == "double"
    out = os.path.join(d, "pred")
    write_predictions(df.select("Id", (F.col("HotelValue") * 2).alias("HotelValue")), out, single_file=True)
    files = [f for f in os.listdir(out) if f.endswith(".csv")]
    assert len(files) == 1
    back = read_table(spark, [out], schema="Id int, HotelValue double", fmt="csv")
    assert sorted(r.HotelValue for r in back.collect()) == [201.0, 400.0, 600.0]
    assert [r.Id for r in preview(back, 2).collect()] == [1, 2]
    rep = shape_report(df, df.where("Id > 1").drop("LandArea")).first()
    assert (rep.rows_before, rep.rows_after, rep.rows_removed, rep.cols_before, rep.cols_after) == (3, 2, 1, 4, 3)
