"""Row-local feature engineering (E1-E17).  Every operator is a projection of
built-in expressions, so a chain of them collapses into one codegen stage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col_, log1p_filled, ordinal_expr, safe_ratio as _safe_ratio
from . import maps


def _has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``fillna(0)`` on the named columns that exist."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols if c in df.columns})


def ordinal_encode(df: DataFrame, spec: Mapping[str, Mapping[str, float]], suffix: str = "",
                   missing: str = "None", default: float = 0.0) -> DataFrame:
    """``fillna('None').map(m).fillna(0)`` per column; overwrites the column
    unless ``suffix`` is given (keep-originals mode, E17)."""
    return df.withColumns({c + suffix: ordinal_expr(c, m, missing, default)
                           for c, m in spec.items() if c in df.columns})


def quality_index(df: DataFrame, cols: Sequence[str] = maps.QUALITY_INDEX_COLUMNS,
                  mapping: Mapping[str, float] = maps.QUALITY_INDEX_MAP,
                  out: str = "TotalQualityScore", case: str = "proper",
                  drop: bool = True) -> DataFrame:
    """Sum of mapped scores over the columns that exist.

    ``case='upper_bug'`` upper-cases the text before a lookup in mixed-case
    keys, as the reference does, so only all-caps keys (``TA``) ever match.
    ``case='proper'`` looks the text up as written."""
    present = [c for c in cols if c in df.columns]
    upper = case == "upper_bug"
    terms = [ordinal_expr(c, mapping, "None", 0.0, upper=upper) for c in present]
    total = reduce(add, terms) if terms else F.lit(0.0)
    df = df.withColumn(out, total)
    return df.drop(*present) if drop else df


def weighted_sum(df: DataFrame, pairs: Sequence[tuple], out: str) -> DataFrame:
    """``sum(w_i * x_i)`` over (weight column, value column) pairs."""
    return df.withColumn(out, reduce(add, [col_(w) * col_(x) for w, x in pairs]))


def sum_columns(df: DataFrame, cols: Sequence[str], out: str, fill_zero: bool = True,
                drop: bool = False) -> DataFrame:
    """Sum of parts (missing parts count 0 when ``fill_zero``)."""
    present = [c for c in cols if c in df.columns]
    parts = [F.coalesce(F.col(c), F.lit(0)) if fill_zero else F.col(c) for c in present]
    df = df.withColumn(out, reduce(add, parts) if parts else F.lit(0.0))
    return df.drop(*present) if drop else df


def safe_ratio(df: DataFrame, num: str, den: str, out: str, default: float = 0.0) -> DataFrame:
    """E5: ``num/den`` where ``den > 0``, else ``default``."""
    return df.withColumn(out, _safe_ratio(num, den, default))


def age_features(df: DataFrame, sold: str = "YearSold", built: str = "ConstructionYear",
                 renovated: str = "RenovationYear", age_out: str = "HouseAge",
                 since_out: str = "YearsSinceModification", repair: bool = True,
                 keep_renovated: bool = False) -> DataFrame:
    """Age at sale; renovation year 0/missing -> construction year;
    years since the later of construction and renovation (``greatest`` skips
    nulls like ``max(axis=1)``).  ``keep_renovated`` leaves the year as it was."""
    out = {age_out: F.col(sold) - F.col(built)}
    ren = F.col(renovated)
    if repair:
        ren = F.coalesce(F.nullif(ren, F.lit(0)), F.col(built))
        if not keep_renovated:
            out[renovated] = ren
    out[since_out] = F.col(sold) - F.greatest(F.col(built), ren)
    return df.withColumns(out)


def interaction(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """E11."""
    return df.withColumn(out, F.col(a) * F.col(b))


def weighted_count(df: DataFrame, weights: Mapping[str, float], out: str) -> DataFrame:
    """``sum(w * col)``, only when every named column exists."""
    if not _has(df, *weights):
        return df
    return df.withColumn(out, reduce(add, [F.col(c) * F.lit(float(w)) for c, w in weights.items()]))


def log_features(df: DataFrame, cols: Sequence[str], keep: bool = True,
                 suffix: str = "_Log") -> DataFrame:
    """``<c>_Log = log1p(fillna(0))`` for the columns that exist; the
    sources are dropped unless ``keep``.  A value <= -1 gives null."""
    present = [c for c in cols if c in df.columns]
    df = df.withColumns({c + suffix: log1p_filled(c) for c in present})
    return df if keep else df.drop(*present)


def target_forward(c, kind: str = "log1p") -> Column:
    """E15 forward transform of the target."""
    return F.log1p(col_(c)) if kind == "log1p" else col_(c).cast("double")


def target_inverse(c, kind: str = "log1p") -> Column:
    """E15 inverse transform of a prediction."""
    return F.expm1(col_(c)) if kind == "log1p" else col_(c).cast("double")


# --------------------------------------------------------------------------
# The reference's property-table workflow, as one configurable projection.
# --------------------------------------------------------------------------

DEFAULT_CONFIG = {
    "basement_merge": True,      # E1-E5 on the basement facility columns
    "basement_ratio": True,      # E5 (removed in some variants)
    "pool": True,                # E6
    "porch": "4",                # E7: "4", "3", or None
    "porch_drop": True,
    "parking_maps": True,        # E2 parking
    "quality_maps": True,        # E2 exterior/basement/kitchen/heating + functionality/exposure
    "tree_extra_maps": False,    # E2x: True for lounge and basement height, or a list of columns
    "quality_index": None,       # E16: None, "proper" or "upper_bug"
    "ages": True,                # E8-E10
    "repair": True,              # E9 (not in every variant)
    "interaction": False,        # E11
    "bath_count": False,         # E12
    "log_list": "L2",            # E13: "L1" (sources kept), "L2", "L3" (sources dropped) or None
    "drop_dates": True,          # E14
    "drop_list": [c for c in maps.DROP_LIST if c != "Id"],  # the key stays for scoring
    "suffix": "",                # E17 keep-originals mode when not empty: nothing is dropped or overwritten
}


def engineer(df: DataFrame, config: Mapping | None = None) -> DataFrame:
    """The full property-table feature chain (E1-E17) for one config.
    Train and scoring tables go through the same function; no statistic is
    computed here, so nothing leaks between them.

    With a ``suffix`` (E17) every original column stays as it was: derived
    columns end in the suffix, mapped ones in ``_Mapped``, and a log feature is
    made where the original of that name exists."""
    cfg = dict(DEFAULT_CONFIG, **(config or {}))
    sfx = cfg["suffix"]
    before = set(df.columns)
    if cfg["basement_merge"] and _has(df, "BasementFacilitySF1", "BasementFacilitySF2",
                                       "BasementFacilityType1", "BasementFacilityType2"):
        a1, a2 = (F.coalesce(F.col(c), F.lit(0)) for c in ("BasementFacilitySF1", "BasementFacilitySF2"))
        t1 = ordinal_expr("BasementFacilityType1", maps.BASEMENT_TYPE_MAP)
        t2 = ordinal_expr("BasementFacilityType2", maps.BASEMENT_TYPE_MAP)
        df = df.withColumns({"TotalBasementScore" + sfx: t1 * a1 + t2 * a2, "BasementFinishedSF" + sfx: a1 + a2})
        if cfg["basement_ratio"]:
            df = safe_ratio(df, "TotalBasementScore" + sfx, "BasementFinishedSF" + sfx, "BasementAvgQuality" + sfx)
        if not sfx:
            df = df.drop("BasementFacilityType1", "BasementFacilityType2",
                         "BasementFacilitySF1", "BasementFacilitySF2")
    if cfg["pool"] and _has(df, "SwimmingPoolArea", "PoolQuality"):
        area = F.coalesce(F.col("SwimmingPoolArea"), F.lit(0))
        df = df.withColumn("TotalPoolScore" + sfx, ordinal_expr("PoolQuality", maps.POOL_QUALITY_MAP) * area)
        if not sfx:
            df = df.drop("PoolQuality", "SwimmingPoolArea")
    if cfg["porch"]:
        parts = maps.PORCH_COLUMNS_4 if cfg["porch"] == "4" else maps.PORCH_COLUMNS_3
        if not sfx or any(c in before for c in parts):
            df = sum_columns(df, parts, "TotalPorchArea" + sfx, drop=cfg["porch_drop"] and not sfx)
    spec = {}
    if cfg["parking_maps"]:
        spec.update({c: maps.QUALITY_MAP_5PT for c in maps.PARKING_5PT_COLUMNS})
        spec["ParkingFinish"] = maps.PARKING_FINISH_MAP
    if cfg["quality_maps"]:
        spec.update({c: maps.QUALITY_MAP_5PT for c in maps.QUALITY_5PT_COLUMNS})
        spec["PropertyFunctionality"] = maps.FUNCTIONALITY_MAP
        spec["BasementExposure"] = maps.EXPOSURE_MAP
    if cfg["tree_extra_maps"]:
        extra = maps.TREE_EXTRA_5PT_COLUMNS if cfg["tree_extra_maps"] is True else cfg["tree_extra_maps"]
        spec.update({c: maps.QUALITY_MAP_5PT for c in extra})
    if cfg["quality_index"]:
        df = quality_index(df, out="TotalQualityScore" + sfx, case=cfg["quality_index"], drop=not sfx)
    if spec:
        df = ordinal_encode(df, spec, suffix=("_Mapped" if sfx else ""))
    if cfg["ages"] and _has(df, "YearSold", "ConstructionYear", "RenovationYear"):
        df = age_features(df, age_out="HouseAge" + sfx, since_out="YearsSinceModification" + sfx,
                          repair=cfg["repair"], keep_renovated=bool(sfx))
    if cfg["interaction"] and _has(df, "OverallQuality", "UsableArea"):
        df = interaction(df, "OverallQuality", "UsableArea", "QualityArea" + sfx)
    if cfg["bath_count"]:
        df = weighted_count(df, {"FullBaths": 1.0, "HalfBaths": 0.5}, "TotalBathrooms" + sfx)
    if cfg["log_list"]:
        logs = {"L1": maps.LOG_LIST_L1, "L2": maps.LOG_LIST_L2, "L3": maps.LOG_LIST_L3}[cfg["log_list"]]
        if sfx:
            logs = [c for c in logs if c in before]
        df = log_features(df, logs, keep=bool(sfx) or cfg["log_list"] == "L1")
    if not sfx:
        if cfg["drop_dates"]:
            df = df.drop(*maps.DATE_SOURCE_COLUMNS)
        if cfg["drop_list"]:
            df = df.drop(*[c for c in cfg["drop_list"] if c in df.columns])
    return df
