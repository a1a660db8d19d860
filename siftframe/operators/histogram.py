"""Equal-width histograms: Freedman-Diaconis distribution (D5/D6) and the
chart histogram (E4)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.binning import edge, widened
from siftframe.functions.classify import classify, measure_columns
from siftframe.functions.exprs import as_double, fixed
from siftframe.plans.quantiles import quantiles
from siftframe.plans.wide import wide_agg
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame

FD_SCHEMA = "column_name string, n long, iqr double, min double, max double, n_bins int"


def _ranges(df: DataFrame, cols: list[str], settings: Settings) -> dict[str, dict]:
    types = {f.name: f.dataType for f in df.schema.fields}
    per = {c: [("n", F.count(as_double(c, types[c]))), ("lo", F.min(as_double(c, types[c]))),
               ("hi", F.max(as_double(c, types[c])))] for c in cols}
    return wide_agg(df, per, settings)


#: {column: (n, min, max, q1, q3)} of an earlier scan.
Bounds = dict[str, tuple]


def fd_bins(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT,
            bounds: Bounds | None = None) -> dict[str, tuple[int, float, float, float, int]]:
    """``{column: (n, iqr, min, max, bins)}`` by the Freedman-Diaconis rule.

    width = 2 IQR n^(-1/3), bins = ceil(range / width) (at least 1), IQR 0 ->
    floor(sqrt(n)), capped at ``max_dist_bins``; columns need 2+ values, and
    a column whose range or IQR is not finite is left out.
    """
    cols = measure_columns(df, classify(df).numeric if cols is None else cols)
    if bounds is None:
        rng = _ranges(df, cols, settings)
        cols = [c for c in cols if (rng[c]["n"] or 0) >= 2]
        qs = quantiles(df, cols, [0.25, 0.75], settings,
                       counts={c: (rng[c]["n"], rng[c]["n"], rng[c]["lo"], rng[c]["hi"]) for c in cols})
        bounds = {c: (rng[c]["n"], rng[c]["lo"], rng[c]["hi"], *qs[c]) for c in cols}
    out = {}
    for c in cols:
        n, lo, hi, q1, q3 = bounds[c]
        if n < 2:
            continue
        iqr = float(q3 - q1)
        if not (math.isfinite(iqr) and math.isfinite(hi - lo)):
            continue  # no bin width: the column has no distribution
        if iqr > 0:
            width = 2 * iqr * (n ** (-1 / 3))
            k = max(1, int(math.ceil((hi - lo) / width)))
        else:
            k = max(1, int(math.sqrt(n)))
        out[c] = (n, iqr, lo, hi, min(k, settings.max_dist_bins))
    return out


def fd_bin_count(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    plan = fd_bins(df, cols, settings)
    return local_frame(df.sparkSession, 
        [(c, n, iqr, lo, hi, k) for c, (n, iqr, lo, hi, k) in plan.items()], FD_SCHEMA)


def binned_counts(df: DataFrame, plan: dict[str, tuple[float, float, int]] | list[tuple[str, float, float, int]]) -> DataFrame:
    """``(column_name, bin, lower, upper, count, ci)`` for ``{column: (min, max, k)}``, or for a list of
    ``(column, min, max, k)`` that may bin a column twice; ``ci`` is the entry's index.

    All columns are unpivoted into one ``(ci, x, lo, hi, k)`` frame so a single
    bin rule (computed in successive projections, each step a plain column)
    serves every column; rows are counted per (column, bin) with partial
    aggregation, and the small grid of all bins is joined on so empty bins
    show as 0.
    """
    spark = df.sparkSession
    types = {f.name: f.dataType for f in df.schema.fields}
    plan = [(c, *p) for c, p in plan.items()] if isinstance(plan, dict) else plan
    if not plan:
        return local_frame(spark, [], "column_name string, bin int, lower double, upper double, count long, ci int")
    cells = []
    for i, (c, lo, hi, k) in enumerate(plan):
        cells.append(F.struct(F.lit(i).alias("ci"), as_double(c, types[c]).alias("x"),
                              F.lit(float(lo)).alias("lo0"), F.lit(float(hi)).alias("hi0"),
                              F.lit(int(k)).alias("k")))
    x, k = F.col("x"), F.col("k")
    long = df.select(F.inline(F.array(*cells))).where(x.isNotNull())
    wlo, whi = widened(F.col("lo0"), F.col("hi0"))
    long = long.select("ci", "x", "k", wlo.alias("lo"), whi.alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    long = long.withColumn("_b0", F.floor((x - lo) * (k / (hi - lo))))
    long = long.withColumn("_b1", F.when(F.col("_b0") >= k, k - 1).otherwise(F.col("_b0")))
    long = long.withColumn("_b2", F.when(x < edge(F.col("_b1"), lo, hi, k), F.col("_b1") - 1)
                           .otherwise(F.col("_b1")))
    long = long.withColumn("bin", F.when((x >= edge(F.col("_b2") + 1, lo, hi, k)) & (F.col("_b2") != k - 1),
                                         F.col("_b2") + 1).otherwise(F.col("_b2")).cast("int"))
    counts = long.groupBy("ci", "bin").agg(F.count(F.lit(1)).alias("count"))
    # Empty bins: add a zero row per bin and sum. A join here would make the
    # optimizer infer a NOT NULL filter on ``bin`` and copy the whole bin
    # rule into it; the union keeps the plan linear.
    grid = local_frame(spark, [(i, b, 0) for i, p in enumerate(plan) for b in range(p[3])],
                       "ci int, bin int, count long")
    names = F.array(*[F.lit(p[0]) for p in plan])
    los = F.array(*[F.lit(float(p[1])) for p in plan])
    his = F.array(*[F.lit(float(p[2])) for p in plan])
    ks = F.array(*[F.lit(int(p[3])) for p in plan])
    filled = counts.unionByName(grid).groupBy("ci", "bin").agg(F.sum("count").cast("long").alias("count"))
    pick = F.col("ci") + 1
    glo, ghi = widened(F.element_at(los, pick), F.element_at(his, pick))
    gk = F.element_at(ks, pick)
    return filled.select(F.element_at(names, pick).alias("column_name"), "bin",
                         edge(F.col("bin"), glo, ghi, gk).alias("lower"),
                         edge(F.col("bin") + 1, glo, ghi, gk).alias("upper"), "count", "ci")


def distribution(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Freedman-Diaconis histogram rows ``(column_name, bin, lower, upper, label, count)``;
    the label is ``lower-upper`` with 2 decimals."""
    plan = fd_bins(df, cols, settings)
    return distribution_rows(binned_counts(df, [(c, lo, hi, k) for c, (_, _, lo, hi, k) in plan.items()]))


def distribution_rows(counts: DataFrame) -> DataFrame:
    return counts.select("column_name", "bin", "lower", "upper",
                         F.concat(fixed(F.col("lower"), 2), F.lit("-"), fixed(F.col("upper"), 2)).alias("label"), "count")


def histogram_series(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Chart histogram for the first 4 numeric columns; label = left edge with 1 decimal."""
    return histogram_rows(binned_counts(df, [(c, *p) for c, p in chart_bins(df, cols, settings).items()]))


def chart_bins(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT,
               bounds: Bounds | None = None) -> dict[str, tuple[float, float, int]]:
    """``{column: (min, max, bins)}`` for the first 4 numeric columns (or ``cols``): bins = min(30, max(5, floor(sqrt(n)))).

    A column whose range is not finite has no bins and is left out."""
    cols = measure_columns(df, classify(df).numeric)[:4] if cols is None else measure_columns(df, cols)
    if bounds is None:
        bounds = {c: (r["n"], r["lo"], r["hi"]) for c, r in _ranges(df, cols, settings).items()}
    plan = {}
    for c in cols:
        n, lo, hi = bounds[c][:3]
        if (n or 0) < 2 or not math.isfinite(hi - lo):
            continue
        plan[c] = (lo, hi, min(settings.hist_max_bins, max(settings.hist_min_bins, int(math.sqrt(n)))))
    return plan


def histogram_rows(counts: DataFrame) -> DataFrame:
    return counts.select("column_name", "bin", "lower",
                         fixed(F.col("lower"), 1).alias("label"), "count")
