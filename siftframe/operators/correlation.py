"""Pearson correlation matrix and reported pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.classify import classify
from siftframe.functions.exprs import as_double, round_keep_sign, safe_corr
from siftframe.plans.gram import co_moments
from siftframe.plans.wide import field_budget, wide_agg
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame

MATRIX_SCHEMA = "i int, j int, col1 string, col2 string, r double"
PAIRS_SCHEMA = ("rank int, col1 string, col2 string, correlation double, p_band double, "
                "n long, t_stat double")


def _complete(df: DataFrame, cols: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    vals = df.select(*[as_double(c, types[c]).alias(f"c{i}") for i, c in enumerate(cols)])
    return vals.dropna(subset=vals.columns)


def _from_products(n: int, products) -> tuple[dict[tuple[int, int], float | None], int]:
    """r of every pair i<=j from the matrix of centred products of ``n`` rows."""
    roots = [math.sqrt(v) if v >= 0 else math.nan for v in products.diagonal()]
    rs: dict[tuple[int, int], float | None] = {}
    for i, a in enumerate(roots):
        rs[(i, i)] = 1.0 if a > 0 else None
        for j in range(i + 1, len(roots)):
            r = products[i, j] / (a * roots[j]) if a * roots[j] > 0 else math.nan
            rs[(i, j)] = None if math.isnan(r) else float(r)
    return rs, n


def correlations(df: DataFrame, cols: list[str] | None = None,
                 settings: Settings = DEFAULT) -> tuple[list[str], dict[tuple[int, int], float | None], int]:
    """Raw r for every pair i<j over rows complete in *all* ``cols``.

    Few columns are one wide SQL aggregate; where its buffers would not fit
    the codegen budget, the pairs come from blocks of the Gram matrix (one
    scan up to 1,024 columns). r is NULL (never an ANSI error) for a constant
    column.
    """
    cols = classify(df).numeric if cols is None else cols
    if len(cols) < 2:
        return cols, {}, 0
    sub = _complete(df, cols)
    if 2 * len(cols) * (len(cols) - 1) + 2 * len(cols) + 1 > field_budget(df):
        return cols, *_from_products(*co_moments(sub))
    per = {}
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            x, y = F.col(f"c{i}"), F.col(f"c{j}")
            per[(i, j)] = [("r", safe_corr(x, y))]
    per["_"] = [("n", F.count(F.lit(1)))] + [(f"sd{i}", F.stddev_samp(F.col(f"c{i}"))) for i in range(len(cols))]
    res = wide_agg(sub, per, settings)
    n = res["_"]["n"]
    rs = {}
    for k, v in res.items():
        if k == "_":
            continue
        r = v["r"]
        rs[k] = None if r is None or math.isnan(r) else r
    for i in range(len(cols)):
        sd = res["_"][f"sd{i}"]
        rs[(i, i)] = 1.0 if sd is not None and not math.isnan(sd) and sd > 0 else None
    return cols, rs, n


def correlation_matrix(df: DataFrame, cols: list[str] | None = None,
                       settings: Settings = DEFAULT, known: tuple | None = None) -> DataFrame:
    """Long form ``(i, j, col1, col2, r)`` of the full symmetric matrix, 4 decimals.

    ``known`` is an earlier result of ``correlations`` on the same columns.
    """
    cols, rs, _ = known or correlations(df, cols, settings)
    rows = []
    for i in range(len(cols)):
        for j in range(len(cols)):
            if not rs:
                continue
            r = rs.get((min(i, j), max(i, j)))
            rows.append((i, j, cols[i], cols[j], r))
    out = local_frame(df.sparkSession, rows, MATRIX_SCHEMA)
    return out.withColumn("r", round_keep_sign(F.col("r"), 4))


def pair_rows(cols, rs, n, settings: Settings = DEFAULT) -> list[tuple]:
    """Pairs i<j with |r| >= corr_min_abs, ordered by |r rounded to 4| desc, stable."""
    found = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            r = rs.get((i, j))
            if r is None or abs(r) < settings.corr_min_abs:
                continue
            band = 0.001 if abs(r) > settings.corr_band_strong else 0.049
            # a (numerically) perfect fit has no finite t
            t = r * math.sqrt(n - 2) / math.sqrt(1 - r * r) if n > 2 and 1 - r * r > 1e-12 else None
            found.append((cols[i], cols[j], r, band, n, t))
    found.sort(key=lambda p: -abs(round(p[2], 4)))
    return [(k + 1, *p) for k, p in enumerate(found)]


def significant_pairs(df: DataFrame, cols: list[str] | None = None,
                      settings: Settings = DEFAULT, known: tuple | None = None) -> DataFrame:
    """``(rank, col1, col2, correlation, p_band, n, t_stat)``.

    ``p_band`` is the reference's fixed two-level value, not a p-value; ``n``
    and ``t_stat`` let a caller compute a real one. ``known`` is an earlier
    result of ``correlations`` on the same columns.
    """
    cols, rs, n = known or correlations(df, cols, settings)
    out = local_frame(df.sparkSession, pair_rows(cols, rs, n, settings), PAIRS_SCHEMA)
    return (out.withColumn("correlation", round_keep_sign(F.col("correlation"), 4))
            .withColumn("t_stat", round_keep_sign(F.col("t_stat"), 4)))


def heatmap_cells(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """Matrix cells for a heatmap; empty unless there are at least two numeric columns."""
    cols = classify(df).numeric if cols is None else cols
    if len(cols) < 2:
        return local_frame(df.sparkSession, [], MATRIX_SCHEMA)
    return correlation_matrix(df, cols, settings)
