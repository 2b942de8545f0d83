from .exprs import (DEFAULT_SEED, clip_lower, hash_bucket, hash_unit, log1p_filled, not_true,
                    ordinal_expr, safe_ratio)
from .quantiles import exact_quantiles, medians
from .ranking import global_index

__all__ = [
    "DEFAULT_SEED", "clip_lower", "hash_bucket", "hash_unit", "log1p_filled", "not_true",
    "ordinal_expr", "safe_ratio", "exact_quantiles", "medians", "global_index",
]
