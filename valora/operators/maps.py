"""Fixed values that must equal the reference workflow's for equal results:
ordinal maps, log-feature lists, drop lists, rule thresholds and the default
search spaces.  Kept together, in the reference's natural order."""

# ---- fixed values: ordinal maps ------------------------------------------------
BASEMENT_TYPE_MAP = {"GLQ": 5, "ALQ": 4, "BLQ": 3, "Rec": 3, "LwQ": 2, "Unf": 1, "None": 0}
POOL_QUALITY_MAP = {"None": 0, "Fa": 1, "Ex": 2}
QUALITY_MAP_5PT = {"Ex": 5, "Gd": 4, "TA": 3, "Fa": 2, "Po": 1, "None": 0}
PARKING_FINISH_MAP = {"Fin": 3, "RFn": 2, "Unf": 1, "None": 0}
FUNCTIONALITY_MAP = {"Typ": 7, "Min1": 6, "Min2": 5, "Mod": 4, "Maj1": 3, "Maj2": 2, "Sev": 1,
                     "None": 0}
EXPOSURE_MAP = {"Gd": 4, "Av": 3, "Mn": 2, "No": 1, "None": 0}

# ---- fixed values: columns mapped with the 5-point map ---------------------------
PARKING_5PT_COLUMNS = ["ParkingQuality", "ParkingCondition"]
QUALITY_5PT_COLUMNS = ["ExteriorQuality", "ExteriorCondition", "BasementCondition",
                       "KitchenQuality", "HeatingQuality"]
TREE_EXTRA_5PT_COLUMNS = ["LoungeQuality", "BasementHeight"]

# ---- fixed values: summed quality index (map keys are mixed case) -------------
QUALITY_INDEX_MAP = {"Ex": 5, "Gd": 4, "TA": 3, "Fa": 2, "Po": 1, "None": 0, "No": 0, "NaN": 0}
QUALITY_INDEX_COLUMNS = ["ExteriorQuality", "ExteriorCondition", "KitchenQuality",
                         "HeatingQuality", "BasementCondition", "BasementExposure",
                         "LoungeQuality", "ParkingQuality"]

# ---- fixed values: porch parts ----------------------------------------------------
PORCH_COLUMNS_4 = ["OpenVerandaArea", "EnclosedVerandaArea", "SeasonalPorchArea", "ScreenPorchArea"]
PORCH_COLUMNS_3 = ["EnclosedVerandaArea", "SeasonalPorchArea", "ScreenPorchArea"]

# ---- fixed values: log-feature lists ----------------------------------------------
LOG_LIST_L1 = ["RoadAccessLength", "LandArea", "FacadeArea", "BasementTotalSF", "ParkingArea"]
LOG_LIST_L2 = ["ParkingConstructionYear", "BasementFinishedSF", "YearsSinceModification",
               "LandArea", "BasementTotalSF", "ParkingArea"]
LOG_LIST_L3 = ["LandArea", "BasementTotalSF", "ParkingArea"]

# ---- fixed values: drop lists -------------------------------------------------------
# The reference list lacks a comma between 'PropertyClass' and 'BasementHalfBaths', so it
# names one unknown column and drops neither; DROP_LIST_PARITY keeps that behaviour.
DROP_LIST = ["Id", "BoundaryFence", "ExtraFacility", "ServiceLaneType", "PropertyClass",
             "BasementHalfBaths", "LowQualityArea", "FacadeType"]
DROP_LIST_PARITY = ["Id", "BoundaryFence", "ExtraFacility", "ServiceLaneType",
                    "PropertyClassBasementHalfBaths", "LowQualityArea", "FacadeType"]
MULTICOLLINEAR_DROP = ["BasementFinishedSF", "UsableArea", "FullBaths", "RoadAccessLength"]
DATE_SOURCE_COLUMNS = ["ConstructionYear", "RenovationYear", "YearSold", "MonthSold"]

# ---- fixed values: targeted zero-impute list --------------------------------------
ZERO_IMPUTE_COLUMNS = ["RoadAccessLength", "TotalPorchArea", "BasementTotalSF",
                       "BasementFinishedSF", "FacadeArea", "ParkingArea", "TotalBasementScore",
                       "Fireplaces", "LandArea", "RoadAccessLength_Log", "FacadeArea_Log",
                       "BasementTotalSF_Log", "ParkingArea_Log", "LandArea_Log"]

# ---- fixed values: outlier rules ----------------------------------------------------
TARGET_TRIM = (0.001, 0.999)
USABLE_AREA_CAP = 4000
RULE_QUALITY_LT = {"a": 5, "b": 3, "c": 3}
RULE_AREA_GT = {"a": 3000, "b": 3000, "c": None}

# ---- fixed values: search spaces ----------------------------------------------------
RIDGE_ALPHA_RANGE = (1e-6, 10.0)
RIDGE_TOL_RANGE = (1e-5, 1e-2)
ELASTIC_NET_L1_RATIOS = [0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]
LASSO_N_ALPHAS = 100
LASSO_EPS = 1e-3
KNN_NEIGHBORS = [3, 5, 7, 10]
KNN_PCA_COMPONENTS = [50, 100, 0.95, 0.99]
FOREST_GRID = {"numTrees": [100, 200], "maxDepth": [None, 20], "minInstancesPerNode": [1, 3]}
FOREST_SAMPLED_SPACE = {"numTrees": ("int", 100, 500), "maxDepth": ("int", 10, 50),
                        "minInstancesPerNode": ("int", 1, 10),
                        "featureSubsetStrategy": ("uniform", 0.1, 1.0)}
FOREST_BASELINE = {"numTrees": 100, "maxDepth": None, "minInstancesPerNode": 1}
BOOSTED_SPACE = {"n_estimators": ("int", 100, 1000), "learning_rate": ("log-uniform", 0.01, 0.3),
                 "max_depth": ("int", 3, 10), "subsample": ("uniform", 0.7, 1.0), "colsample": ("uniform", 0.7, 1.0),
                 "l1": ("log-uniform", 0.01, 10.0), "l2": ("log-uniform", 0.01, 10.0)}
EARLY_STOPPED = {"n_estimators": 1000, "learning_rate": 0.05, "max_depth": 4, "patience": 50}
EARLY_STOPPED_REGULARIZED = {"n_estimators": 2000, "learning_rate": 0.01, "max_depth": 3, "min_child": 5, "gamma": 0.1,
                             "l1": 0.1, "l2": 1.0, "patience": 100}
LEAFWISE_SPACE = {"num_leaves": ("int", 20, 100), "max_depth": ("int", 3, 10), "learning_rate": ("log-uniform", 0.01, 0.2),
                  "n_estimators": ("int", 200, 800), "min_child": ("int", 5, 50), "subsample": ("uniform", 0.6, 1.0),
                  "colsample": ("uniform", 0.6, 1.0), "l1": ("log-uniform", 1e-4, 1.0), "l2": ("log-uniform", 1e-4, 1.0)}
LEAFWISE_BASELINE = {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "min_child": 20, "l1": 0.0, "l2": 0.0}
BOOSTED_BASELINE = {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6, "subsample": 1.0, "colsample": None}
ADABOOST_BASELINE = {"n_estimators": 50, "learning_rate": 1.0, "loss": "linear", "max_depth": 3}
ADABOOST_SPACE = {"n_estimators": ("int", 50, 500), "learning_rate": ("log-uniform", 1e-3, 1.0),
                  "loss": ("choice", ["linear", "square", "exponential"]),
                  "max_depth": ("int", 2, 8)}
RIDGE_SPACE = {"alpha": ("log-uniform", 1e-6, 10.0), "fit_intercept": ("choice", [True, False]),
               "tol": ("log-uniform", 1e-5, 1e-2)}
