"""IQR outlier fences, flags and counts."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.classify import measure_columns
from siftframe.functions.exprs import as_double, q, put
from siftframe.operators.steplog import LogRow
from siftframe.plans.quantiles import quantiles
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame

BOUNDS_SCHEMA = "column_name string, q1 double, q3 double, iqr double, lower double, upper double"


def iqr_fences(df: DataFrame, cols: list[str] | None = None,
               settings: Settings = DEFAULT) -> dict[str, tuple[float, float, float, float]]:
    """``{column: (q1, q3, lower, upper)}``; columns with IQR 0 or undefined are left out."""
    cols = measure_columns(df) if cols is None else cols
    qs = quantiles(df, cols, [0.25, 0.75], settings)
    out = {}
    for c in cols:
        q1, q3 = qs[c]
        if q1 is None or q3 is None:
            continue
        iqr = q3 - q1
        if math.isnan(iqr) or iqr == 0:
            continue
        k = settings.iqr_multiplier
        out[c] = (q1, q3, q1 - k * iqr, q3 + k * iqr)
    return out


def iqr_bounds(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """(column_name, q1, q3, iqr, lower, upper) per column with a positive IQR."""
    fences = iqr_fences(df, cols, settings)
    rows = [(c, a, b, b - a, lo, hi) for c, (a, b, lo, hi) in fences.items()]
    return local_frame(df.sparkSession, rows, BOUNDS_SCHEMA)


def _outside(df: DataFrame, c: str, lo: float, hi: float):
    types = {f.name: f.dataType for f in df.schema.fields}
    x = as_double(c, types[c])
    return (x < F.lit(lo)) | (x > F.lit(hi))


def outlier_counts(df: DataFrame, fences: dict[str, tuple[float, float, float, float]]) -> dict[str, int]:
    """Rows strictly outside the fences, per column, from one aggregate."""
    if not fences:
        return {}
    row = df.agg(*outlier_count_exprs(df, fences)).first()
    return {c: row[f"o{i}"] for i, c in enumerate(fences)}


def outlier_count_frame(df: DataFrame, cols: list[str] | None = None,
                        settings: Settings = DEFAULT) -> DataFrame:
    """(column_name, outliers) for every column with a positive IQR."""
    fences = iqr_fences(df, cols, settings)
    counts = outlier_counts(df, fences)
    return local_frame(df.sparkSession, list(counts.items()), "column_name string, outliers long")


def outlier_count_exprs(df: DataFrame, fences: dict) -> list:
    """``count_if`` outside the fences per column, aliased ``o<i>``."""
    return [F.count_if(_outside(df, c, lo, hi)).alias(f"o{i}")
            for i, (c, (_, _, lo, hi)) in enumerate(fences.items())]


def add_flags(df: DataFrame, fences: dict, counts: dict[str, int]) -> tuple[DataFrame, list[LogRow], dict[str, int]]:
    """Project ``is_outlier_<col>`` for the columns whose count is positive."""
    counts = {c: n for c, n in counts.items() if n > 0}
    if not counts:
        return df, [], {}
    out = put(df, {f"is_outlier_{c}": F.when(_outside(df, c, fences[c][2], fences[c][3]), 1).otherwise(0).cast("tinyint")
                   for c in counts})
    log = [LogRow("flag_outliers", c, "iqr", n) for c, n in counts.items()]
    return out, log, counts


def flag_outliers(df: DataFrame, cols: list[str] | None = None,
                  settings: Settings = DEFAULT) -> tuple[DataFrame, list[LogRow], dict[str, int]]:
    """Add ``is_outlier_<col>`` (0/1 tinyint) for columns with at least one outlier.

    Fences are literals after one quantile plan; counting is one aggregate;
    the flags are a projection.
    """
    fences = iqr_fences(df, cols, settings)
    return add_flags(df, fences, outlier_counts(df, fences))
