"""Thresholds and limits used across the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Fixed values that must equal the reference behaviour.
    skew_threshold: float = 1.0          # |skew| above this -> median fill
    iqr_multiplier: float = 1.5          # IQR fence multiplier
    datetime_drop_pct: float = 5.0       # datetime gaps below this % -> drop rows
    top_n: int = 10                      # frequency table / bar chart size
    pie_top: int = 7                     # pie chart slices
    corr_min_abs: float = 0.05           # |r| reported as a pair
    corr_band_strong: float = 0.8        # |r| above -> p band 0.001, else 0.049
    strong_r: float = 0.7                # sentence calls |r| above this "strong"
    date_share: float = 0.6              # parsed share needed to convert a column
    max_dist_bins: int = 50              # Freedman-Diaconis cap
    hist_min_bins: int = 5               # chart histogram bin floor
    hist_max_bins: int = 30              # chart histogram bin cap
    line_max_points: int = 200           # line series thinning target
    scatter_points: int = 500            # scatter sample size
    scatter_pairs: int = 3               # scatter charts drawn
    trend_min_rows: int = 10             # rows needed for a trend sentence
    float_atol: float = 5e-4             # float64 -> float32 tolerance

    # Engine choices (not in the reference).
    exact: bool = True                   # exact quantiles/mode; False -> sketches
    narrow_floats: bool = False          # lossy float narrowing is opt-in
    approx_accuracy: int = 10000         # approx_percentile accuracy
    quantile_buckets: int = 4096         # resolution of the rank sketch (its error is rows / this)
    direct_distinct_limit: int = 2_000_000  # values of a column or bracket ranked without range partitions
    rank_cells: int = 64                 # window cells a range is ranked in
    rank_cell_values: int = 4096         # values per cell below which fewer cells are used
    order_buckets: int = 65_536          # max range buckets for global row order
    order_bucket_rows: int = 1_000_000   # rows one ordered window task should hold
    order_sample_per_bucket: int = 16    # sampled keys per bucket to place split points
    wide_agg_chunk: int = 100            # columns per aggregate job


DEFAULT = Settings()
