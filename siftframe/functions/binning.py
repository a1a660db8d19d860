"""Equal-width binning that reproduces numpy.histogram bin assignment.

Edges are ``lo + i * ((hi - lo) / k)`` with the last edge pinned to ``hi``;
a value first gets ``floor((x - lo) * (k / (hi - lo)))`` and is then moved one
bin down or up when it falls on the wrong side of its computed edge, exactly
as numpy corrects floating-point error. A constant column is widened to
``lo - 0.5 .. hi + 0.5``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def widened(lo: Column, hi: Column) -> tuple[Column, Column]:
    same = lo == hi
    return (F.when(same, lo - 0.5).otherwise(lo), F.when(same, hi + 0.5).otherwise(hi))


def edge(i: Column, lo: Column, hi: Column, k: Column) -> Column:
    """Left edge of bin ``i`` (0-based); edge ``k`` is ``hi``."""
    return F.when(i >= k, hi).otherwise(i.cast("double") * ((hi - lo) / k) + lo)


def sql_bin_index(x: str, lo: str, hi: str, k: str) -> str:
    """The same rule written as SQL text (used by the DuckDB oracles)."""

    def e(i: str) -> str:
        return f"(CASE WHEN ({i}) >= {k} THEN {hi} ELSE CAST({i} AS DOUBLE) * (({hi} - {lo}) / {k}) + {lo} END)"

    raw = f"CAST(floor(({x} - {lo}) * ({k} / ({hi} - {lo}))) AS BIGINT)"
    first = f"(CASE WHEN {raw} >= {k} THEN {k} - 1 ELSE {raw} END)"
    down = f"(CASE WHEN {x} < {e(first)} THEN {first} - 1 ELSE {first} END)"
    return f"(CASE WHEN {x} >= {e(down + ' + 1')} AND {down} <> {k} - 1 THEN {down} + 1 ELSE {down} END)"
