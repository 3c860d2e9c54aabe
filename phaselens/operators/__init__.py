"""Composed operators: phase comparison, churn, exact distributed ranking
and quantiles, top share, binning, RFM, keywords, profiling."""

from phaselens.operators.binning import assign_bins, quantile_bins, quantile_edges, rank_bin, rank_bins
from phaselens.operators.churn import churn_counts, churn_summary, flag_active, key_difference
from phaselens.operators.compare import count_in, phase_pivot
from phaselens.operators.keywords import keyword_frequency
from phaselens.operators.profile import (column_types, describe_exact, head_sample, null_columns, null_totals,
                                         profile, profile_shapes)
from phaselens.operators.rank import distributed_ntile, distributed_rank, exact_quantiles, value_quantiles
from phaselens.operators.rfm import rfm_base, rfm_scores, segment_col
from phaselens.operators.topshare import top_share

__all__ = [
    "assign_bins", "quantile_bins", "quantile_edges", "rank_bin", "rank_bins",
    "churn_counts", "churn_summary", "flag_active", "key_difference",
    "count_in", "phase_pivot",
    "keyword_frequency",
    "column_types", "describe_exact", "head_sample", "null_columns", "null_totals", "profile", "profile_shapes",
    "distributed_ntile", "distributed_rank", "exact_quantiles", "value_quantiles",
    "rfm_base", "rfm_scores", "segment_col",
    "top_share",
]
