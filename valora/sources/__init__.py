from .io import NULL_TOKENS, normalize_nulls, preview, read_table, shape_report, write_predictions

__all__ = ["NULL_TOKENS", "normalize_nulls", "preview", "read_table", "shape_report",
           "write_predictions"]
