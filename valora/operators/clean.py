"""Projections, filters and row cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions.exprs import clip_lower, col_, not_true
from ..functions.quantiles import exact_quantiles


def split_target(df: DataFrame, target: str):
    """Feature frame and target column name; the target stays a column of
    the same rows (Spark has no positional index to re-align on)."""
    return df.drop(target), target


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop, ignoring names that do not exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def columns_by_role(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric columns, string columns) from the schema."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, NumericType):
            num.append(f.name)
        elif isinstance(f.dataType, StringType):
            cat.append(f.name)
    return num, cat


def quantile_bounds(df: DataFrame, col: str, lo: float = 0.001, hi: float = 0.999) -> tuple:
    q = exact_quantiles(df, col, [lo, hi])
    return q[float(lo)], q[float(hi)]


def quantile_mask(df: DataFrame, col: str, lo: float = 0.001, hi: float = 0.999) -> Column:
    """Keep-mask ``q(lo) <= col <= q(hi)`` (inclusive, exact interpolated
    quantiles of the table as given).  The bounds become literals, so the
    filter is pushed into the scan."""
    qlo, qhi = quantile_bounds(df, col, lo, hi)
    return F.col(col).between(F.lit(qlo), F.lit(qhi))


def quantile_trim(df: DataFrame, col: str, lo: float = 0.001, hi: float = 0.999) -> DataFrame:
    """P5."""
    return df.where(quantile_mask(df, col, lo, hi))


def cap(df: DataFrame, col: str, maximum: float) -> DataFrame:
    """Keep ``col < maximum``; a null value fails the test (row removed)."""
    return df.where(F.col(col) < F.lit(maximum)) if col in df.columns else df


def exclusion_rule(variant: str, quality: str = "OverallQuality", area: str = "UsableArea",
                   quality_lt: float | None = None, area_gt: float | None = None) -> Column:
    """P7 rule as a *flag* (True = drop).  Variants: ``a`` quality<5 and
    area>3000; ``b`` quality<3 and area>3000; ``c`` quality<3 alone."""
    from .maps import RULE_AREA_GT, RULE_QUALITY_LT
    qlt = RULE_QUALITY_LT[variant] if quality_lt is None else quality_lt
    agt = RULE_AREA_GT[variant] if area_gt is None and variant in RULE_AREA_GT else area_gt
    cond = F.col(quality) < F.lit(qlt)
    if agt is not None:
        cond = cond & (F.col(area) > F.lit(agt))
    return cond


def exclude(df: DataFrame, cond: Column) -> DataFrame:
    """Drop rows where ``cond`` is true; a null test keeps the row."""
    return df.where(not_true(cond))


def drop_missing(df: DataFrame, cols: Sequence[str], numeric: bool = True) -> DataFrame:
    """Coerce to number (bad text -> null) and drop rows missing any."""
    if numeric:
        df = df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in cols})
    return df.dropna(subset=list(cols))


def clip_predictions(df: DataFrame, col: str, lower: float = 0.0) -> DataFrame:
    """P10: negative predictions become 0."""
    return df.withColumn(col, clip_lower(col, lower))


def outlier_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One aggregate row: total rows, rows flagged by each rule (null
    test = not flagged), rows flagged by any rule, rows kept."""
    flags = {name: F.coalesce(col_(c), F.lit(False)) for name, c in rules.items()}
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag = any_flag | f
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.sum(F.when(f, 1).otherwise(0)).cast("long").alias(f"n_{name}") for name, f in flags.items()]
    aggs += [F.sum(F.when(any_flag, 1).otherwise(0)).cast("long").alias("n_removed")]
    out = df.agg(*aggs)
    return out.withColumn("n_kept", F.col("n_rows") - F.col("n_removed"))


def clean_rows(df: DataFrame, target: str, trim=(0.001, 0.999), cap_col: str | None = None,
               cap_max: float | None = None, rule: Column | None = None,
               measured: DataFrame | None = None) -> DataFrame:
    """P5+P6+P7 as the reference applies them: quantiles of the raw table, all
    masks ANDed, one filter.  ``measured`` holds the same target values (say
    staged) for the passes of the quantiles."""
    mask = F.lit(True)
    if trim is not None:
        mask = mask & quantile_mask(df if measured is None else measured, target, *trim)
    if cap_col is not None and cap_col in df.columns:
        mask = mask & (F.col(cap_col) < F.lit(cap_max))
    if rule is not None:
        mask = mask & not_true(rule)
    return df.where(mask)
