"""Exact linear-interpolated quantiles without a single-task value map.

Spark's built-in ``percentile`` merges one value->count map per column in a
single final task, which does not survive a column with billions of distinct
values. This plan finds the order statistics it needs by distributed
selection instead, in at most three scans whatever the distribution:

1. one aggregate gives ``n``, ``min`` and ``max`` per column (or the caller
   has them). A column of at most ``direct_distinct_limit`` values is ranked
   as it is; for any other, a mergeable rank sketch (``percentile_approx``,
   error ``n / quantile_buckets`` ranks) gives two values around every wanted
   rank: its bracket;
2. one aggregate counts the values below and up to each bracket, which fixes
   the bracket's first rank. The sketch is never trusted: a rank that its
   bracket does not hold is looked for in all values on that side;
3. the brackets' values are pre-aggregated to ``(bracket, value, count)`` (a
   hot value collapses map-side), ordered by windows, and the values at the
   wanted ranks are read off. A bracket of more than ``direct_distinct_limit``
   values is written once and ranked over range partitions, each a window of
   its own that starts at the sum of the partitions before it.

Interpolation is ``v[lo] + (h - lo) * (v[hi] - v[lo])`` with
``h = (n - 1) * p`` -- the pandas/numpy default.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftframe.functions.exprs import as_double
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame
from siftframe.session import materialize
from siftframe.sources.parquet import scan_partitions

MAX_PARTS = 65_536  # range partitions a large bracket is ranked in


@dataclass
class _Range:
    col: int
    lo: float | None           # None: no lower end
    hi: float | None
    closed: bool               # whether the ends themselves belong to it
    offset: int                # values of the column ordered before this range
    rows: int                  # values inside
    positions: list[int] = field(default_factory=list)  # wanted global ranks


def _in_range(v: Column, r: _Range) -> Column:
    cond = v.isNotNull()
    if r.lo is not None:
        cond = cond & (v >= F.lit(r.lo) if r.closed else v > F.lit(r.lo))
    if r.hi is not None:
        cond = cond & (v <= F.lit(r.hi) if r.closed else v < F.lit(r.hi))
    return cond


def column_counts(df: DataFrame, cols: list[str], limit: int | None = None) -> dict[str, tuple]:
    """(non-null count, distinct bound, min, max) per column in one job; the
    count is the distinct bound."""
    types = {f.name: f.dataType for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(c, types[c])
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return {c: (row[f"n{i}"], row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}


def quantiles(df: DataFrame, cols: list[str], probs: list[float],
              settings: Settings = DEFAULT,
              counts: dict[str, tuple] | None = None) -> dict[str, list[float | None]]:
    """Quantiles ``probs`` of every column in ``cols`` (missing values ignored).

    ``counts`` may carry ``(n, distinct_bound, min, max)`` per column from an
    aggregate the caller already ran.
    """
    if not cols:
        return {}
    types = {f.name: f.dataType for f in df.schema.fields}
    if not settings.exact:
        row = df.agg(*[
            F.percentile_approx(as_double(c, types[c]), list(probs), settings.approx_accuracy).alias(f"q{i}")
            for i, c in enumerate(cols)]).first()
        return {c: (list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(probs))
                for i, c in enumerate(cols)}

    limit = settings.direct_distinct_limit
    sketched: dict[str, list[float]] = {}
    if counts is None:
        counts, sketched = _counts_and_sketches(df, cols, types, probs, settings)
    base = df.select(*[as_double(c, types[c]).alias(f"_v{i}") for i, c in enumerate(cols)])
    base = _spread_narrow(base, sum(counts[c][0] or 0 for c in cols))

    wanted: dict[int, list[tuple[int, int, float]]] = {}
    ready: list[_Range] = []
    bounds: dict[int, tuple[float, float]] = {}
    large: list[int] = []
    for i, c in enumerate(cols):
        n, _, lo, hi = counts[c]
        if not n:
            continue
        plan = []
        for p in probs:
            h = (n - 1) * p
            flo = int(math.floor(h))
            chi = min(flo + 1, n - 1) if h > flo else flo
            plan.append((flo, chi, h - flo))
        wanted[i] = plan
        bounds[i] = (lo, hi)
        if n > limit:
            large.append(i)
        else:
            ready.append(_Range(i, None, None, True, 0, n, _positions(plan)))

    values: dict[tuple[int, int], float] = {}
    if large:
        missing = [i for i in large if cols[i] not in sketched]
        if missing:
            row = base.agg(*[_sketch(F.col(f"_v{i}"), probs, settings).alias(f"s{i}") for i in missing]).first()
            sketched.update({cols[i]: row[f"s{i}"] for i in missing})
        brackets = [(i, sketched[cols[i]][2 * k], sketched[cols[i]][2 * k + 1], {lo, hi})
                    for i in large for k, (lo, hi, _) in enumerate(wanted[i])]
        found, values = _brackets(base, brackets, [counts[c][0] for c in cols])
        ready += found

    small = [r for r in ready if r.rows <= limit]
    values.update(_select(base, small, bounds, settings))
    values.update(_select_large(base, [r for r in ready if r.rows > limit], settings))
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        if i not in wanted:
            out[c] = [None] * len(probs)
            continue
        res = []
        for lo, hi, frac in wanted[i]:
            a, b = values[(i, lo)], values[(i, hi)]
            res.append(a if lo == hi else a + frac * (b - a))
        out[c] = res
    return out


def _spread_narrow(base: DataFrame, values: int, min_values: int = 2_000_000) -> DataFrame:
    """Unpivoting multiplies rows by columns; when the narrow numeric
    projection arrives in fewer splits than task slots, spread it first (a
    cheap shuffle of a few double columns) so the per-value work runs in
    parallel. A scan that is already split (any cluster input) is left as is."""
    want = base.sparkSession.sparkContext.defaultParallelism
    if values >= min_values and scan_partitions(base) < want:
        return base.repartition(want, F.monotonically_increasing_id())
    return base


def _positions(plan: list[tuple[int, int, float]]) -> list[int]:
    return sorted({x for a, b, _ in plan for x in (a, b)})


def _sketch(v: Column, probs: list[float], settings: Settings) -> Column:
    """Values two sketch errors below and above each probability, in one sketch of the column."""
    margin = 2.0 / settings.quantile_buckets
    ends = [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    return F.percentile_approx(v, ends, settings.quantile_buckets)


def _counts_and_sketches(df: DataFrame, cols: list[str], types: dict, probs: list[float],
                         settings: Settings) -> tuple[dict[str, tuple], dict[str, list[float]]]:
    """``column_counts`` and the sketches in the same scan."""
    aggs = []
    for i, c in enumerate(cols):
        v = as_double(c, types[c])
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
                 _sketch(v, probs, settings).alias(f"s{i}")]
    row = df.agg(*aggs).first()
    counts = {c: (row[f"n{i}"], row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"]) for i, c in enumerate(cols)}
    return counts, {c: row[f"s{i}"] for i, c in enumerate(cols)}


def _brackets(base: DataFrame, brackets: list[tuple[int, float, float, set[int]]], totals: list[int]
              ) -> tuple[list[_Range], dict[tuple[int, int], float]]:
    """(ranges that hold the wanted ranks, values already known) from one counting pass.

    ``brackets`` are (column, low, high, ranks); a bracket of one value needs no
    further look.
    """
    aggs = []
    for j, (i, lo, hi, _) in enumerate(brackets):
        v = F.col(f"_v{i}")
        aggs += [F.count_if(v < F.lit(lo)).alias(f"b{j}"), F.count_if(v <= F.lit(hi)).alias(f"u{j}")]
    row = base.agg(*aggs).first()
    ranges: dict[tuple, _Range] = {}
    known: dict[tuple[int, int], float] = {}
    for j, (i, lo, hi, ranks) in enumerate(brackets):
        below, upto = row[f"b{j}"], row[f"u{j}"]
        for k in ranks:
            if k < below:
                r = _Range(i, None, lo, False, 0, below)
            elif k >= upto:
                r = _Range(i, hi, None, False, upto, totals[i] - upto)
            elif lo == hi:
                known[(i, k)] = lo
                continue
            else:
                r = _Range(i, lo, hi, True, below, upto - below)
            kept = ranges.setdefault((i, r.lo, r.hi, r.closed), r)
            kept.positions = sorted({*kept.positions, k})
    return list(ranges.values()), known


def _span(r: _Range, bounds) -> tuple[float, float]:
    lo, hi = bounds[r.col]
    return (lo if r.lo is None else r.lo), (hi if r.hi is None else r.hi)


def _splittable(r: _Range, bounds) -> bool:
    lo, hi = _span(r, bounds)
    return (lo is not None and hi is not None and math.isfinite(lo) and math.isfinite(hi)
            and hi > lo and math.isfinite(hi - lo))


def _counted(base: DataFrame, ranges: list[_Range]) -> DataFrame:
    """(r, v, n): the distinct values of each range with their counts; other rows are dropped before anything is built."""
    tests = [_in_range(F.col(f"_v{r.col}"), r) for r in ranges]
    parts = [F.when(t, F.struct(F.lit(j).alias("r"), F.col(f"_v{r.col}").alias("v")))
             for j, (r, t) in enumerate(zip(ranges, tests, strict=True))]
    return (base.where(reduce(or_, tests)).select(F.explode(F.array(*parts)).alias("c"))
            .where(F.col("c").isNotNull()).select("c.*")
            .groupBy("r", "v").agg(F.count(F.lit(1)).alias("n")))


def _targets(spark, ranges: list[_Range]) -> DataFrame:
    """One row for each wanted rank, at most columns x probabilities x 2: (r, local, col, pos)."""
    return local_frame(spark, [(j, p - r.offset, r.col, p) for j, r in enumerate(ranges) for p in r.positions],
                       "r int, local long, col int, pos long")


def _read_off(ranked: DataFrame, ranges: list[_Range]) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks of ``ranked`` (r, v, n, upto)."""
    hits = (ranked.join(F.broadcast(_targets(ranked.sparkSession, ranges)), "r")
            .where((F.col("upto") - F.col("n") <= F.col("local")) & (F.col("local") < F.col("upto")))
            .select("col", "pos", "v").collect())
    return {(h["col"], h["pos"]): h["v"] for h in hits}


def _select_large(base: DataFrame, ranges: list[_Range], settings: Settings) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks of ranges too large for one window.

    The counted values are laid out in range partitions of about
    ``direct_distinct_limit`` values, written once; the partitions' totals (one
    row for each partition and range) give every partition its first rank.
    """
    if not ranges:
        return {}
    parts = min(MAX_PARTS, 1 + -(-sum(r.rows for r in ranges) // settings.direct_distinct_limit))
    laid = materialize(_counted(base, ranges).repartitionByRange(parts, "r", "v")
                       .withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("r").orderBy("part")
    starts = laid.groupBy("r", "part").agg(F.sum("n").alias("total")).select(
        "r", "part", (F.sum("total").over(before) - F.col("total")).alias("start"))
    w = Window.partitionBy("r", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = laid.join(F.broadcast(starts), ["r", "part"]).withColumn("upto", F.col("start") + F.sum("n").over(w))
    return _read_off(ranked, ranges)


def _select(base: DataFrame, ready: list[_Range], bounds, settings: Settings = DEFAULT
            ) -> dict[tuple[int, int], float]:
    """Values at the wanted ranks of ranges of at most ``direct_distinct_limit`` values, one job.

    Values are counted per ``(range, value)`` (a hot value collapses
    map-side). A range with many values is further cut into up to
    ``rank_cells`` equal-width cells; the small per-cell count table (at
    most ranges x cells rows) gives each cell its starting rank, so the
    running count is windowed per (range, cell) -- many balanced window
    partitions instead of one per range.
    """
    if not ready:
        return {}
    spans, cells = [], []
    for r in ready:
        lo, hi = _span(r, bounds)
        k = min(settings.rank_cells, max(1, r.rows // settings.rank_cell_values))
        ok = _splittable(r, bounds)
        spans.append((float(lo) if ok else 0.0, float(hi) if ok else 1.0))
        cells.append(k if ok else 1)
    counted = _counted(base, ready)
    pick = F.col("r") + 1
    lo_of = F.element_at(F.array(*[F.lit(a) for a, _ in spans]), pick)
    hi_of = F.element_at(F.array(*[F.lit(b) for _, b in spans]), pick)
    k_of = F.element_at(F.array(*[F.lit(k) for k in cells]), pick)
    x = F.least(F.greatest(F.col("v"), lo_of), hi_of)
    raw = F.floor((x - lo_of) / (hi_of - lo_of) * k_of.cast("double"))
    counted = counted.withColumn("cell", F.least(F.greatest(raw, F.lit(0)), k_of - 1).cast("int"))
    w_cells = Window.partitionBy("r").orderBy("cell")
    # at most sum(cells) <= ranges x rank_cells rows: a proven broadcast bound
    starts = (counted.groupBy("r", "cell").agg(F.sum("n").alias("cn"))
              .select("r", "cell", (F.sum("cn").over(w_cells) - F.col("cn")).alias("start")))
    w = Window.partitionBy("r", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = (counted.join(F.broadcast(starts), ["r", "cell"])
              .withColumn("upto", F.col("start") + F.sum("n").over(w)))
    return _read_off(ranked, ready)
