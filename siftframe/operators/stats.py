"""Descriptive statistics (one row per numeric column)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.classify import classify
from siftframe.functions.exprs import as_double, round_keep_sign, sample_kurtosis, sample_skewness
from siftframe.plans.quantiles import quantiles
from siftframe.plans.wide import wide_agg
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame

STATS_SCHEMA = T.StructType([
    T.StructField("position", T.IntegerType()),
    T.StructField("column_name", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("skewness", T.DoubleType()),
    T.StructField("kurtosis", T.DoubleType()),
    T.StructField("missing_pct", T.DoubleType()),
])


def moment_exprs(x: Column) -> list[tuple[str, Column]]:
    """``[(name, aggregate)]`` of one numeric column's moments and bounds."""
    n, lo, hi = F.count(x), F.min(x), F.max(x)
    return [("count", n), ("mean", F.avg(x)), ("std", F.stddev_samp(x)),
            ("min", lo), ("max", hi),
            ("skewness", sample_skewness(x, n, lo, hi)),
            ("kurtosis", sample_kurtosis(x, n, lo, hi)),
            ("rows", F.count(F.lit(1)))]


def moments(df: DataFrame, cols: list[str], settings: Settings = DEFAULT) -> dict[str, dict]:
    """Raw (unrounded) statistics for ``cols``: one wide aggregate + quantile plan."""
    types = {f.name: f.dataType for f in df.schema.fields}
    res = wide_agg(df, {c: moment_exprs(as_double(c, types[c])) for c in cols}, settings)
    med = quantiles(df, cols, [0.5], settings,
                    counts={c: (res[c]["count"], res[c]["count"], res[c]["min"], res[c]["max"])
                            for c in cols})
    for c in cols:
        res[c]["median"] = med[c][0]
    return res


def descriptive_stats(df: DataFrame, cols: list[str] | None = None,
                      settings: Settings = DEFAULT, raw: dict[str, dict] | None = None) -> DataFrame:
    """count, mean, median, std, min, max, skewness, kurtosis, missing % per column.

    Columns with no values are skipped. Values are rounded to 4 decimals
    (missing_pct to 2) inside Spark, after all arithmetic. ``raw`` is an
    earlier result of ``moments`` on ``df``.
    """
    cols = classify(df).numeric if cols is None else cols
    spark = df.sparkSession
    if raw is None:
        raw = moments(df, cols, settings) if cols else {}
    rows = []
    for i, c in enumerate(cols):
        s = raw[c]
        if not s["count"]:
            continue
        missing = (s["rows"] - s["count"]) / s["rows"] * 100.0
        rows.append((i, c, s["count"], s["mean"], s["median"], s["std"], s["min"], s["max"],
                     s["skewness"], s["kurtosis"], missing))
    out = local_frame(spark, rows, STATS_SCHEMA)
    r4 = ["mean", "median", "std", "min", "max", "skewness", "kurtosis"]
    return out.select("position", "column_name", "count",
                      *[round_keep_sign(F.col(c), 4).alias(c) for c in r4],
                      F.round("missing_pct", 2).alias("missing_pct"))
