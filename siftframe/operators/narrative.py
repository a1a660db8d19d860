"""Plain-language insight rows (F1-F8) and the chart catalog.

Every number comes from the statistics operators (small result frames);
only the final wording happens on the driver, over at most a few rows per
column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.classify import classify, measure_columns
from siftframe.functions.exprs import as_double, q
from siftframe.operators.correlation import correlations, pair_rows
from siftframe.operators.frequency import frequency_table
from siftframe.operators.series import linear_trend
from siftframe.operators.stats import descriptive_stats
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame

SENTENCE_SCHEMA = "seq int, kind string, column_name string, sentence string"
CATALOG_SCHEMA = "seq int, chart_type string, title string, x string, y string"


def insight_rows(df: DataFrame, settings: Settings = DEFAULT, tiebreak: list[str] = (),
                 stats: DataFrame | None = None, known: tuple | None = None, n_rows: int | None = None,
                 tops: DataFrame | None = None, paths: dict | None = None) -> list[tuple]:
    kinds = classify(df)
    n_rows = df.count() if n_rows is None else n_rows
    out: list[tuple[str, str | None, str]] = []
    out.append(("overview", None,
                f"{n_rows:,} rows in {len(df.columns)} columns: {len(kinds.numeric)} numeric, "
                f"{len(kinds.categorical)} categorical, {len(kinds.datetime)} datetime."))
    stats = descriptive_stats(df, kinds.numeric, settings) if stats is None else stats
    stats = sorted(stats.collect(), key=lambda r: r["position"])
    for s in stats:
        c = s["column_name"]
        out.append(("range", c, f"'{c}' spans {s['min']:,.2f} to {s['max']:,.2f} "
                               f"(mean {s['mean']:,.2f}, median {s['median']:,.2f})."))
        sk = s["skewness"]
        if sk is not None and not math.isnan(sk) and abs(sk) > 1:
            side = "right" if sk > 0 else "left"
            out.append(("skewed", c, f"'{c}' has a long {side} tail (skewness {sk:.2f})."))
    if stats:
        best = stats[0]
        for s in stats[1:]:
            if s["max"] > best["max"]:
                best = s
        out.append(("maximum", best["column_name"],
                    f"The largest value, {best['max']:,.2f}, is in '{best['column_name']}'."))
    cols, rs, n = known or correlations(df, kinds.numeric, settings)
    pairs = pair_rows(cols, rs, n, settings)
    if pairs:
        _, c1, c2, r, band, _, _ = pairs[0]
        r = round(r, 4)
        strength = "strong" if abs(r) > settings.strong_r else "moderate"
        sign = "positive" if r > 0 else "negative"
        out.append(("correlation", f"{c1},{c2}",
                    f"'{c1}' and '{c2}' move together: {strength} {sign} correlation "
                    f"(r = {r:.2f}, band {band:.4f})."))
    if kinds.categorical:
        tops = frequency_table(df, kinds.categorical, 1, settings) if tops is None else tops.where("rank = 1")
        freq = tops.collect()
        by_col = {r["column_name"]: r for r in freq}
        for c in kinds.categorical:
            r = by_col.get(c)
            if r is None:
                continue
            out.append(("top_category", c,
                        f"Most common '{c}' is '{r['value']}' ({r['percentage']:.1f}% of values; "
                        f"{r['unique_count']} distinct)."))
    for t in kinds.datetime:
        for v in kinds.numeric[:2]:
            tr = linear_trend(df, t, v, tiebreak, settings, paths and paths[t, v]).collect()
            if tr:
                row = tr[0]
                out.append(("trend", v, f"'{v}' trends {row['direction']} along '{t}' "
                                        f"(R^2 = {row['r2']:.2f})."))
    return [(i, k, c, s) for i, (k, c, s) in enumerate(out)]


def insight_sentences(df: DataFrame, settings: Settings = DEFAULT, tiebreak: list[str] = (),
                      stats: DataFrame | None = None, known: tuple | None = None, n_rows: int | None = None,
                      tops: DataFrame | None = None, paths: dict | None = None) -> DataFrame:
    """``(seq, kind, column_name, sentence)``: overview; range (+ skew) per numeric
    column; column with the largest value; strongest pair; top category per
    categorical; trend per datetime x first 2 numerics. ``stats``, ``known`` and ``tops`` are
    earlier results of ``descriptive_stats``, ``correlations`` and ``frequency_table`` on ``df``, ``n_rows`` its
    row count and ``paths`` what ``linear_trend`` takes as ``sums`` per (time, value)."""
    return local_frame(df.sparkSession, insight_rows(df, settings, tiebreak, stats, known, n_rows, tops, paths), SENTENCE_SCHEMA)


def chart_catalog(df: DataFrame, settings: Settings = DEFAULT, known: tuple | None = None,
                  counts: dict[tuple, int] | None = None) -> DataFrame:
    """``(seq, chart_type, title, x, y)`` for every chart the data supports, in
    the order line, bar, pie, histogram, scatter, heatmap. One aggregate
    supplies all the row counts the rules need, unless ``counts`` has them:
    rows with a value per (column,) and with both per (time, value)."""
    kinds = classify(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    nums3, nums2, nums4 = kinds.numeric[:3], kinds.numeric[:2], measure_columns(df, kinds.numeric)[:4]
    cats3 = kinds.categorical[:3]
    if counts is None:
        wanted = {(t, v): F.count_if(q(t).isNotNull() & as_double(v, types[v]).isNotNull())
                  for t in kinds.datetime for v in nums3}
        wanted |= {(c,): F.count(q(c)) for c in cats3} | {(v,): F.count(as_double(v, types[v])) for v in nums4}
        found = df.agg(*[e.alias(f"n{i}") for i, e in enumerate(wanted.values())]).first() if wanted else ()
        counts = dict(zip(wanted, found))
    rows = []
    for t in kinds.datetime:
        for v in nums3:
            if counts[t, v] >= 2:
                rows.append(("line", f"{v} over {t}", t, v))
    for c in cats3:
        if counts[c,] > 0:
            for v in nums2:
                rows.append(("bar", f"mean {v} by {c}", c, v))
    for c in cats3:
        if counts[c,] > 0:
            rows.append(("pie", f"share of {c}", c, None))
    for v in nums4:
        if counts[v,] >= 2:
            rows.append(("histogram", f"histogram of {v}", v, None))
    cols, rs, n = known or correlations(df, kinds.numeric, settings)
    for p in pair_rows(cols, rs, n, settings)[:settings.scatter_pairs]:
        rows.append(("scatter", f"{p[1]} vs {p[2]} (r = {round(p[3], 4):.2f})", p[1], p[2]))
    if len(kinds.numeric) >= 2:
        rows.append(("heatmap", "correlation matrix", None, None))
    return local_frame(df.sparkSession, [(i, *r) for i, r in enumerate(rows)], CATALOG_SCHEMA)
