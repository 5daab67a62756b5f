"""Scalar helpers reproducing the reference dialect (boundary DATEDIFF, Sunday weeks, integer AVG, ...)."""

from clickmetrics.functions.compat import (
    boundary_diff,
    epoch_micros,
    int_avg,
    label_marker,
    ntz,
    pct,
    pct_scaled_first,
    round_half_away,
    safe_ratio,
    soundex_difference,
    time_bucket,
    week_start,
)

__all__ = [
    "boundary_diff", "epoch_micros", "int_avg", "label_marker", "ntz", "pct",
    "pct_scaled_first", "round_half_away", "safe_ratio", "soundex_difference", "time_bucket", "week_start",
]
