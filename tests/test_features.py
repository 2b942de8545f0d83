"""Hand-made edge cases (FIXTURES.md section 3) for the row-local operators."""
import math

from pyspark.sql import functions as F

from valora.operators import clean, features, maps
from valora.sources import normalize_nulls


def test_cap_removes_null_predictor(spark):
    df = spark.createDataFrame([(1, 3500.0), (2, None), (3, 4500.0)], "Id int, UsableArea double")
    assert [r.Id for r in clean.cap(df, "UsableArea", 4000).collect()] == [1]


def test_compound_exclusion_keeps_null_test(spark):
    df = spark.createDataFrame([(1, None, 3500.0), (2, 2, 3500.0), (3, 2, 2000.0)],
                               "Id int, OverallQuality int, UsableArea double")
    kept = clean.exclude(df, clean.exclusion_rule("b"))
    assert sorted(r.Id for r in kept.collect()) == [1, 3]
    kept_c = clean.exclude(df, clean.exclusion_rule("c"))
    assert sorted(r.Id for r in kept_c.collect()) == [1]


def test_ordinal_unknown_null_and_tokens(spark):
    df = spark.createDataFrame([("ZZ",), (None,), ("None",), ("NA",), ("Gd",)], "KitchenQuality string")
    df = normalize_nulls(df)
    out = features.ordinal_encode(df, {"KitchenQuality": maps.QUALITY_MAP_5PT}).collect()
    assert [r.KitchenQuality for r in out] == [0.0, 0.0, 0.0, 0.0, 4.0]


def test_pool_code_missing_in_map(spark):
    df = spark.createDataFrame([("Gd", 100.0), ("Ex", 10.0), (None, None)], "PoolQuality string, SwimmingPoolArea double")
    out = features.engineer(df, {"basement_merge": False, "porch": None, "parking_maps": False,
                                 "quality_maps": False, "ages": False, "log_list": None})
    assert [r.TotalPoolScore for r in out.collect()] == [0.0, 20.0, 0.0]


def test_guarded_ratio_zero_denominator(spark):
    df = spark.createDataFrame([(0.0, 0.0), (6.0, 3.0)], "s double, f double")
    out = features.safe_ratio(df, "s", "f", "r").collect()
    assert [r.r for r in out] == [0.0, 2.0]


def test_age_features_renovation_rules(spark):
    df = spark.createDataFrame([(2008, 1990, 0), (2008, 1990, None), (2007, 1990, 2008), (2010, 1990, 2000)],
                               "YearSold int, ConstructionYear int, RenovationYear int")
    out = features.age_features(df).collect()
    assert [r.RenovationYear for r in out] == [1990, 1990, 2008, 2000]
    assert [r.YearsSinceModification for r in out] == [18, 18, -1, 10]
    assert [r.HouseAge for r in out] == [18, 18, 17, 20]
    logs = features.log_features(features.age_features(df), ["YearsSinceModification"]).collect()
    assert logs[2].YearsSinceModification_Log is None  # log1p(-1): null, imputed later
    assert math.isclose(logs[0].YearsSinceModification_Log, math.log1p(18))


def test_log_of_null_is_zero(spark):
    df = spark.createDataFrame([(None,), (3.0,)], "LandArea double")
    out = features.log_features(df, ["LandArea"], keep=False).collect()
    assert out[0].LandArea_Log == 0.0 and "LandArea" not in out[0].asDict()


def test_quality_index_case_modes(spark):
    df = spark.createDataFrame([("Ex", "Gd", "TA")], "ExteriorQuality string, KitchenQuality string, HeatingQuality string")
    assert features.quality_index(df, case="upper_bug").first().TotalQualityScore == 3.0
    assert features.quality_index(df, case="proper").first().TotalQualityScore == 12.0


def test_engineer_reference_chain(spark):
    row = {"Id": 1, "BasementFacilityType1": "GLQ", "BasementFacilityType2": "Unf", "BasementFacilitySF1": 100.0,
           "BasementFacilitySF2": None, "PoolQuality": None, "SwimmingPoolArea": None,
           "OpenVerandaArea": 10.0, "EnclosedVerandaArea": None, "SeasonalPorchArea": 5.0, "ScreenPorchArea": 0.0,
           "ParkingQuality": "TA", "ParkingCondition": None, "ParkingFinish": "RFn", "ExteriorQuality": "Gd",
           "ExteriorCondition": "TA", "BasementCondition": "Fa", "BasementExposure": "Av", "KitchenQuality": "Ex",
           "HeatingQuality": "Po", "PropertyFunctionality": "Min2", "YearSold": 2010, "MonthSold": 5,
           "ConstructionYear": 2000, "RenovationYear": 0, "LandArea": 1000.0, "BasementTotalSF": None,
           "ParkingConstructionYear": 2001.0, "ParkingArea": 400.0, "BoundaryFence": "x", "FacadeType": "y"}
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None and k.endswith(('Type1','Type2','Quality','Condition','Finish','Exposure','Functionality')) else ('int' if isinstance(v, int) else 'double')}"
                       for k, v in row.items())
    df = spark.createDataFrame([tuple(row.values())], schema)
    out = features.engineer(df).first().asDict()
    assert out["TotalBasementScore"] == 500.0 and out["BasementAvgQuality"] == 5.0
    assert out["TotalPoolScore"] == 0.0 and out["TotalPorchArea"] == 15.0
    assert (out["ParkingQuality"], out["ParkingCondition"], out["ParkingFinish"]) == (3.0, 0.0, 2.0)
    assert out["PropertyFunctionality"] == 5.0 and out["BasementExposure"] == 3.0
    assert out["HouseAge"] == 10
    assert math.isclose(out["YearsSinceModification_Log"], math.log1p(10))
    assert math.isclose(out["BasementFinishedSF_Log"], math.log1p(100.0))
    assert out["BasementTotalSF_Log"] == 0.0
    for gone in ["BoundaryFence", "FacadeType", "YearSold", "ConstructionYear", "LandArea", "BasementFacilitySF1"]:
        assert gone not in out
    assert out["Id"] == 1


def test_clip_and_target_roundtrip(spark):
    df = spark.createDataFrame([(-10.0,), (5.0,)], "p double")
    assert [r.p for r in clean.clip_predictions(df, "p").collect()] == [0.0, 5.0]
    back = df.select(features.target_inverse(features.target_forward(F.abs("p"))).alias("b")).collect()
    assert math.isclose(back[0].b, 10.0) and math.isclose(back[1].b, 5.0)


def test_outlier_report_counts(spark):
    df = spark.createDataFrame([(1.0, 1), (5000.0, 2), (None, 9)], "UsableArea double, OverallQuality int")
    r = clean.outlier_report(df, {"cap": ~(F.col("UsableArea") < 4000), "rule": F.col("OverallQuality") < 3}).first()
    assert (r.n_rows, r.n_cap, r.n_rule, r.n_removed, r.n_kept) == (3, 1, 2, 2, 1)


def test_keep_originals_leaves_every_column_as_it_was(spark):
    df = spark.createDataFrame(
        [(1, "Ex", 0, 1990, 2008, 5.0, None), (2, None, 2000, 1990, 2008, None, 3.0)],
        "Id int, KitchenQuality string, RenovationYear int, ConstructionYear int, YearSold int, LandArea double, "
        "ScreenPorchArea double")
    out = features.engineer(df, {"suffix": "_New", "log_list": "L2", "interaction": True})
    assert [tuple(r)[:7] for r in out.orderBy("Id").collect()] == [tuple(r) for r in df.orderBy("Id").collect()]
    assert out.columns[7:] == ["TotalPorchArea_New", "KitchenQuality_Mapped", "HouseAge_New", "YearsSinceModification_New",
                               "LandArea_Log"]
    assert [(r.YearsSinceModification_New, r.TotalPorchArea_New) for r in out.orderBy("Id").collect()] == [(18, 0.0), (8, 3.0)]
    none = features.engineer(df.drop("ScreenPorchArea"), {"suffix": "_New"})
    assert "TotalPorchArea_New" not in none.columns  # no part, no constant column


def test_options_without_repair_and_short_log_list(spark):
    df = spark.createDataFrame([(1, 0, 1990, 2008, 5.0, 7.0)],
                               "Id int, RenovationYear int, ConstructionYear int, YearSold int, LandArea double, ParkingArea double")
    out = features.engineer(df, {"repair": False, "log_list": "L3", "porch": None}).first().asDict()
    assert out == {"Id": 1, "HouseAge": 18, "YearsSinceModification": 18,
                   "LandArea_Log": math.log1p(5.0), "ParkingArea_Log": math.log1p(7.0)}
