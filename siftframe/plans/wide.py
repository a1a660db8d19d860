"""Run many per-column aggregates as few, wide aggregate jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame

from siftframe.settings import DEFAULT, Settings

# Aggregation-buffer fields per statistic (Spark keeps e.g. n, mean, m2, m3
# for skewness). Whole-stage codegen is switched off for an aggregate whose
# buffers exceed ``spark.sql.codegen.maxFields``, which makes it several
# times slower, so chunks are sized to stay under that budget.
BUFFER_FIELDS = {"count": 1, "n": 1, "rows": 1, "min": 1, "max": 1, "lo": 1, "hi": 1,
                 "mean": 2, "std": 3, "skew": 4, "skewness": 4, "kurtosis": 5, "r": 4}


def field_budget(df: DataFrame) -> int:
    try:
        limit = int(df.sparkSession.conf.get("spark.sql.codegen.maxFields", "100"))
    except (TypeError, ValueError):
        limit = 100
    return max(8, limit - 4)


def wide_agg(df: DataFrame, per_column: dict, settings: Settings = DEFAULT) -> dict:
    """Evaluate ``{column: [(stat, agg_expr), ...]}`` in chunked single-row aggs.

    A chunk holds as many columns as fit the codegen field budget (and at
    most ``wide_agg_chunk``); each chunk is one scan returning one small row,
    so driver memory is bounded by the column count.
    """
    names = list(per_column)
    out: dict = {c: {} for c in names}
    budget = field_budget(df)
    chunks, cur, used = [], [], 0
    for c in names:
        cost = sum(BUFFER_FIELDS.get(stat, 2) for stat, _ in per_column[c])
        if cur and (used + cost > budget or len(cur) >= settings.wide_agg_chunk):
            chunks.append(cur)
            cur, used = [], 0
        cur.append(c)
        used += cost
    if cur:
        chunks.append(cur)
    for chunk in chunks:
        exprs, keys = [], []
        for i, c in enumerate(chunk):
            for stat, e in per_column[c]:
                alias = f"a{i}_{len(keys)}"
                exprs.append(e.alias(alias))
                keys.append((c, stat, alias))
        if not exprs:
            continue
        row = df.agg(*exprs).first()
        for c, stat, alias in keys:
            out[c][stat] = row[alias]
    return out
