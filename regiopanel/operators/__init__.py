"""DataFrame -> DataFrame operators."""

from regiopanel.operators.aggregate import describe, distinct_values, exact_quantiles, mean_by, min_sample_gate
from regiopanel.operators.evaluate import hash_split, regression_metrics, split_bucket
from regiopanel.operators.joins import intersect_values, keep_common, left_join_keys
from regiopanel.operators.nulls import drop_incomplete, fill_nulls
from regiopanel.operators.panel import build_panel, panel_features
from regiopanel.operators.report import (
    error_bars,
    metric_summary,
    metrics_by_region,
    scatter_bounds,
    sort_frame,
    top_k_per_group,
)
from regiopanel.operators.reshape import metric_matrix, pivot_categories, unpivot_digit_columns
from regiopanel.operators.schema import (
    digit_columns,
    drop_unnamed,
    preview,
    profile_shape,
    safe_names,
    trim_names,
)

__all__ = [
    "build_panel", "describe", "digit_columns", "distinct_values", "drop_incomplete", "drop_unnamed",
    "error_bars", "exact_quantiles", "fill_nulls", "hash_split", "intersect_values", "keep_common",
    "left_join_keys", "mean_by", "metric_matrix", "metric_summary", "metrics_by_region", "min_sample_gate",
    "panel_features", "pivot_categories", "preview", "profile_shape", "regression_metrics", "safe_names", "scatter_bounds",
    "sort_frame", "split_bucket", "top_k_per_group", "trim_names", "unpivot_digit_columns",
]
