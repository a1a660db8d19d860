"""Co-moments of many columns from one scan, as blocks of the Gram matrix.

Each task folds its rows into one matrix of centred products (Chan's merge of
counts, means and products) and hands it on in blocks of BLOCK x BLOCK
columns, at most one set a task. Blocks are merged in two steps, first in
LANES groups by partition, so no task meets the partial results of all others.
The work stays in numpy inside Arrow batches: a SQL aggregate would need four
buffer fields a pair. Functions for the tasks are closures, so executors need
no copy of this package.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 64
LANES = 1024
COLUMNS = 1024      # columns that one scan takes: a task's matrix is at most 8 MB
ROWS = 4096         # rows that are multiplied at once
PARTIAL = "block int, lane int, n long, a array<double>, b array<double>, c array<double>"


def _tasks(k: int):
    """(partial results of a task, merge of a block's partial results) for ``k`` columns."""
    cuts = [(lo, min(lo + BLOCK, k)) for lo in range(0, k, BLOCK)]
    step, lanes = ROWS, LANES
    kinds = [("block", pa.int32()), ("lane", pa.int32()), ("n", pa.int64()),
             *[(name, pa.list_(pa.float64())) for name in "abc"]]

    def merge(x, y):
        """Of (n, means of the rows, means of the columns, products): both together."""
        if not x or not y:
            return x or y
        n = x[0] + y[0]
        da, db = y[1] - x[1], y[2] - x[2]
        return (n, x[1] + da * (y[0] / n), x[2] + db * (y[0] / n),
                x[3] + y[3] + np.outer(da, db) * (x[0] * (y[0] / n)))

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        held = None
        with np.errstate(all="ignore"):
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns])
                    first = x[0].copy()     # a constant column is zero from here on, without rounding
                    x -= first
                    mean = x.mean(axis=0)
                    x -= mean
                    held = merge(held, (len(x), first + mean, first + mean, x.T @ x))
        if held:
            lane = TaskContext.get().partitionId() % lanes
            n, mean, _, c = held
            pairs = [(i, j) for i in range(len(cuts)) for j in range(i, len(cuts))]
            for at, (i, j) in enumerate(pairs):
                (a, b), (d, e) = cuts[i], cuts[j]
                yield pa.RecordBatch.from_pylist(
                    [{"block": at, "lane": lane, "n": n, "a": mean[a:b], "b": mean[d:e], "c": c[a:b, d:e].ravel()}],
                    schema=pa.schema(kinds))

    def merged(table: pa.Table) -> pa.Table:
        held = None
        with np.errstate(all="ignore"):
            for batch in table.to_batches(max_chunksize=64):
                for row in range(batch.num_rows):
                    a, b, c = (batch.column(i)[row].values.to_numpy() for i in (3, 4, 5))
                    held = merge(held, (batch.column(2)[row].as_py(), a, b, c.reshape(len(a), len(b))))
        n, a, b, c = held
        return pa.Table.from_pylist([{"block": table.column(0)[0].as_py(), "lane": table.column(1)[0].as_py(),
                                      "n": n, "a": a, "b": b, "c": c.ravel()}], schema=pa.schema(kinds))

    return cuts, partials, merged


def co_moment_blocks(df: DataFrame) -> DataFrame:
    """One row a block (see PARTIAL) for the double columns of ``df``, which hold no NULL."""
    _, partials, merged = _tasks(len(df.columns))
    parts = df.mapInArrow(partials, PARTIAL)
    parts = parts.groupBy("block", "lane").applyInArrow(merged, PARTIAL)
    return parts.groupBy("block").applyInArrow(merged, PARTIAL)


def co_moments(df: DataFrame) -> tuple[int, np.ndarray]:
    """(rows, matrix of centred products) of the double columns of ``df``, which hold no NULL.

    Up to COLUMNS columns are one scan; more are taken in pairs of halves of
    that size. The matrix (columns squared) is the caller's report and lies on
    the driver.
    """
    names, k = df.columns, len(df.columns)
    n, out = 0, np.zeros((k, k))
    half = COLUMNS // 2
    groups = [range(lo, min(lo + half, k)) for lo in range(0, k, half)]
    sets = [list(range(k))] if k <= COLUMNS else [
        [*groups[i], *groups[j]] for i in range(len(groups)) for j in range(i + 1, len(groups))]
    for at in sets:
        part = df.select(*[F.col(names[i]) for i in at])
        cuts = _tasks(len(at))[0]
        pairs = [(x, y) for p, x in enumerate(cuts) for y in cuts[p:]]
        at = np.array(at)
        for row in co_moment_blocks(part).select("block", "n", "c").collect():
            (a, b), (d, e) = pairs[row["block"]]
            c = np.array(row["c"]).reshape(b - a, e - d)
            out[np.ix_(at[a:b], at[d:e])] = c
            out[np.ix_(at[d:e], at[a:b])] = c.T
            n = row["n"]
    return n, out
