"""Column-expression helpers.  Everything here returns a ``Column`` built from
``pyspark.sql.functions`` so it stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default seed of every shuffled split/fold in the reference workflow.
DEFAULT_SEED = 42


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_unit(key, seed: int = DEFAULT_SEED) -> Column:
    """Deterministic 32-bit hash of ``key`` and ``seed`` as a bigint in
    [0, 2**32).  Depends only on the key value, never on partitioning, so a
    row lands in the same split/fold on 1 or 1000 executors.  The same value is
    computable in plain SQL engines: first 8 hex digits of md5('<key>:<seed>')."""
    text = F.concat(col_(key).cast("string"), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_bucket(key, k: int, seed: int = DEFAULT_SEED) -> Column:
    """Bucket in [0, k) from :func:`hash_unit`."""
    return F.pmod(hash_unit(key, seed), F.lit(k)).cast("int")


def safe_ratio(num, den, default: float = 0.0) -> Column:
    """``num/den`` when ``den > 0`` else ``default`` (no ANSI divide error)."""
    den = col_(den)
    return F.when(den > 0, col_(num).cast("double") / den).otherwise(F.lit(default).cast("double"))


def ordinal_expr(c, mapping: Mapping[str, float], missing: str = "None",
                 default: float = 0.0, upper: bool = False) -> Column:
    """``fillna(missing).map(mapping).fillna(default)`` as one expression.

    ``upper=True`` upper-cases the text before the lookup (reproduces the
    summed-quality-index variant whose keys are mixed case)."""
    text = F.coalesce(col_(c).cast("string"), F.lit(missing))
    if upper:
        text = F.upper(text)
    # branches, not a map value: generated code compares in place, no map is looked through
    out = None
    for k, v in mapping.items():
        hit, value = text == F.lit(k), F.lit(float(v))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(float(default)) if out is None else out.otherwise(F.lit(float(default)))


def log1p_filled(c) -> Column:
    """``log1p(fillna(0))``; values <= -1 give null (imputed later)."""
    return F.log1p(F.coalesce(col_(c).cast("double"), F.lit(0.0)))


def clip_lower(c, lower: float = 0.0) -> Column:
    return F.greatest(col_(c).cast("double"), F.lit(float(lower)))


def not_true(cond: Column) -> Column:
    """``~cond`` with pandas semantics for a missing operand: a null test is
    False, so the row is kept (``NOT coalesce(cond, false)``)."""
    return ~F.coalesce(cond, F.lit(False))
