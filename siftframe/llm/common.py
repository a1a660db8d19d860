"""Table access, shared-folder staging and small column helpers of the text operators."""

from __future__ import annotations

import string
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED_DIR = "spark.checkpoint.dir"
BATCH_ROWS = 256
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it.

    Only a local session without the setting gets a private folder (tests).
    """
    found = spark.conf.get(SHARED_DIR, None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"{SHARED_DIR} must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="siftframe-shared-")
        spark.conf.set(SHARED_DIR, found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage like a checkpoint, but stays columnar: later reads are
    pruned and a lost executor costs nothing that was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows, so very long texts cannot pile up in one batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``limit`` bytes of a text or binary column, one row at least."""
    lo = size = 0
    lengths = pc.binary_length(batch.column(column)).to_pylist()
    for row, length in enumerate(lengths):
        if row > lo and size + (length or 0) > limit:
            yield batch.slice(lo, row - lo)
            lo, size = row, 0
        size += length or 0
    yield batch.slice(lo)


def per_worker(key: Hashable, make: Callable):
    """``make()``, once for a Python worker.

    The value lives in a module that no file stands behind, so that functions
    sent by value find it again without this package on the worker's path.
    """
    held = sys.modules.setdefault("_siftframe_worker", types.ModuleType("_siftframe_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, text, ...) of a documents-like frame; whatever else it holds stays outside."""
    return docs.select("doc_id", "text", *more)


def by_run(key: str, work: Callable[[pa.Table], Iterator[tuple]], schema: pa.Schema, least: int = 1):
    """A mapInArrow function that calls ``work`` with all rows of one value of ``key`` (a long).

    Rows must come sorted by the key and each value in one partition; of the
    values' rows, one value's at a time is held over a batch's end. Values
    with fewer than ``least`` rows are passed over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(parts)
            of = np.asarray(table.column(key))
            cuts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1, [len(of)])).tolist()
            found = [row for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) if hi - lo >= least
                     for row in work(table.slice(lo, hi - lo))]
            if found:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.asarray(batch.column(key))
            last = int(np.searchsorted(of, of[-1]))
            if held and (last or np.asarray(held[-1].column(key))[-1] != of[0]):
                yield from flush([*held, batch.slice(0, last)] if last else held)
                held = []
            elif last:
                yield from flush([batch.slice(0, last)])
            held.append(batch.slice(last))
        if held:
            yield from flush(held)

    return run
