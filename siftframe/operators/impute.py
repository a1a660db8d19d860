"""Missing-value imputation.

Columns are handled left to right as the reference does: a datetime column
with few gaps drops those rows, which changes the statistics of every column
to its right. Datetime decisions are made first (few columns, one small
count job each); then every other column gets its fill value from a single
wide aggregate in which each column only sees the rows that survive the
drops to its left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftframe.functions.classify import is_boolean, is_datetime, kind_of_type
from siftframe.functions.exprs import as_double, q, sample_skewness
from siftframe.operators.profile import missing_expr
from siftframe.operators.steplog import LogRow
from siftframe.plans.ordering import forward_fill
from siftframe.plans.quantiles import quantiles
from siftframe.plans.wide import wide_agg
from siftframe.settings import DEFAULT, Settings


def _numeric_stats(x: Column) -> list[tuple[str, Column]]:
    n, lo, hi = F.count(x), F.min(x), F.max(x)
    return [("n", n), ("mean", F.avg(x)), ("skew", sample_skewness(x, n, lo, hi)), ("lo", lo), ("hi", hi)]


def numeric_fill_values(df: DataFrame, cols: list[str], settings: Settings = DEFAULT,
                        masks: dict[str, Column] | None = None,
                        stats: dict[str, dict] | None = None) -> dict[str, tuple[str, float | None]]:
    """Per numeric column: ('median'|'mean', fill) from one aggregate (+ median plan).

    ``|sample skewness| > skew_threshold`` picks the median, otherwise the mean
    (a missing skewness also means mean). The test runs on the driver with
    Python floats so NaN never compares true.
    """
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    masks = masks or {}

    def val(c):
        x = as_double(c, types[c])
        return F.when(masks[c], x) if c in masks else x

    if stats is None:
        stats = wide_agg(df, {c: _numeric_stats(val(c)) for c in cols}, settings)
    need_median = [c for c in cols if stats[c]["skew"] is not None
                   and not math.isnan(stats[c]["skew"]) and abs(stats[c]["skew"]) > settings.skew_threshold]
    med = {}
    if need_median:
        masked = df.select(*[val(c).alias(c) for c in need_median])
        med = quantiles(masked, need_median, [0.5], settings,
                        counts={c: (stats[c]["n"], stats[c]["n"], stats[c]["lo"], stats[c]["hi"])
                                for c in need_median})
    out = {}
    for c in cols:
        if not stats[c]["n"]:
            out[c] = ("mean", None)
        elif c in med:
            out[c] = ("median", med[c][0])
        else:
            out[c] = ("mean", stats[c]["mean"])
    return out


def mode_values(df: DataFrame, cols: list[str], masks: dict[str, Column] | None = None) -> dict[str, str | None]:
    """Most frequent value per column (as text), ties -> smallest; one shuffle.

    Values are unpivoted to ``(column, value)``, counted with map-side partial
    aggregation, and the top row per column is kept by a window limit that
    Spark applies before the exchange as well.
    """
    if not cols:
        return {}
    masks = masks or {}
    cells = [F.struct(F.lit(i).alias("k"),
                      (F.when(masks[c], q(c)) if c in masks else q(c)).cast("string").alias("v"))
             for i, c in enumerate(cols)]
    counted = (df.select(F.inline(F.array(*cells))).where(F.col("v").isNotNull())
               .groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy("k").orderBy(F.desc("n"), F.asc("v"))
    top = counted.withColumn("r", F.row_number().over(w)).where("r = 1").collect()
    found = {row["k"]: row["v"] for row in top}
    return {c: found.get(i) for i, c in enumerate(cols)}


def impute(df: DataFrame, settings: Settings = DEFAULT, order_by: list[str] | None = None,
           partition_keys: list[str] = ()) -> tuple[DataFrame, list[LogRow]]:
    """Fill or drop gaps column by column."""
    fields = df.schema.fields
    types = {f.name: f.dataType for f in fields}
    # one scan: gaps per column, plus the fill statistics of every numeric
    # column (used as they are unless a datetime drop changes the rows)
    measured = [f.name for f in fields if kind_of_type(f.dataType) == "numeric" and not is_boolean(f.dataType)]
    extra = [e.alias(f"s{i}_{k}") for i, c in enumerate(measured)
             for k, e in _numeric_stats(as_double(c, types[c]))]
    first = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if(missing_expr(f.name, f.dataType)).alias(f"m{i}") for i, f in enumerate(fields)], *extra).first()
    rows = first["_rows"]
    missing = {f.name: first[f"m{i}"] for i, f in enumerate(fields)}
    pre_stats = {c: {k: first[f"s{i}_{k}"] for k in ("n", "mean", "skew", "lo", "hi")}
                 for i, c in enumerate(measured)}

    # 1. datetime columns, left to right (drops change what later columns see)
    keep = F.lit(True)
    keep_before: dict[str, Column] = {}
    dropped_any = False
    log_dt: dict[str, LogRow] = {}
    ffill_cols: list[str] = []
    for f in fields:
        keep_before[f.name] = keep
        if not is_datetime(f.dataType) or not missing[f.name]:
            continue
        if dropped_any:
            cnt = df.where(keep).agg(F.count(F.lit(1)).alias("r"),
                                     F.count_if(q(f.name).isNull()).alias("m")).first()
            cur_rows, miss = cnt["r"], cnt["m"]
        else:
            cur_rows, miss = rows, missing[f.name]
        if not miss:
            continue
        pct = miss / cur_rows * 100
        if pct < settings.datetime_drop_pct:
            log_dt[f.name] = LogRow("drop_missing_datetime", f.name, f"dropped_rows ({pct:.1f}%)", miss)
            keep = keep & q(f.name).isNotNull()
            dropped_any = True
        else:
            log_dt[f.name] = LogRow("forward_fill", f.name, "forward_fill", miss)
            ffill_cols.append(f.name)

    # 2. every other column with gaps: statistics over the surviving rows
    masks = {c: keep_before[c] for c in types} if dropped_any else {}
    if dropped_any:
        recount = df.agg(*[F.count_if(keep_before[f.name] & missing_expr(f.name, f.dataType)).alias(f"m{i}")
                           for i, f in enumerate(fields)]).first()
        missing_now = {f.name: recount[f"m{i}"] for i, f in enumerate(fields)}
    else:
        missing_now = missing
    numeric = [f.name for f in fields if kind_of_type(f.dataType) == "numeric"
               and not is_boolean(f.dataType) and missing_now[f.name]]
    other = [f.name for f in fields if missing_now[f.name] and not is_datetime(f.dataType)
             and f.name not in numeric and kind_of_type(f.dataType) != "other"]
    fills = numeric_fill_values(df, numeric, settings, {c: masks[c] for c in numeric if c in masks},
                                None if dropped_any else {c: pre_stats[c] for c in numeric})
    modes = mode_values(df, other, {c: masks[c] for c in other if c in masks})

    log: list[LogRow] = []
    exprs = []
    for f in fields:
        c = f.name
        if c in fills and fills[c][1] is not None:
            strategy, value = fills[c]
            exprs.append(F.coalesce(as_double(c, f.dataType), F.lit(float(value))).alias(c))
            log.append(LogRow("impute", c, strategy, missing_now[c]))
        elif c in modes and modes[c] is not None:
            exprs.append(F.coalesce(q(c), F.lit(modes[c]).cast(f.dataType)).alias(c))
            log.append(LogRow("impute", c, "mode", missing_now[c]))
        else:
            if c in log_dt:
                log.append(log_dt[c])
            exprs.append(q(c))
    if ffill_cols and not order_by:
        raise ValueError("forward fill needs order_by (row order is not defined in Spark)")
    out = df.select(*exprs)
    # left to right: a fill sees the rows that the columns to its left kept,
    # and rows a later column drops still lend their values to it
    together: list[str] = []
    for f in fields:
        if f.name in ffill_cols:
            together.append(f.name)
        elif f.name in log_dt:
            if together:
                out = forward_fill(out, together, order_by, list(partition_keys), settings)
                together = []
            out = out.where(q(f.name).isNotNull())
    if together:
        out = forward_fill(out, together, order_by, list(partition_keys), settings)
    # keep log in column order
    order = {f.name: i for i, f in enumerate(fields)}
    log.sort(key=lambda r: order.get(r.column, -1))
    return out, log
