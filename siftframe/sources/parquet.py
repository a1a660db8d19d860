"""Parquet source (the durable typed form of a cleaned table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD_MIN_BYTES = 128 * 1024 * 1024


def scan_partitions(df: DataFrame) -> int:
    """Partitions of a frame that reads without shuffling; a large number
    (no spreading needed) when its plan already has an exchange.

    Asking a shuffling frame for ``rdd.getNumPartitions()`` would make
    adaptive execution run its shuffle stages right away, work the later
    query does not reuse; such a frame has shuffle partitions anyway.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return 1 << 30
    return df.rdd.getNumPartitions()


def spread(df: DataFrame, min_partitions: int | None = None,
           min_bytes: int = SPREAD_MIN_BYTES) -> DataFrame:
    """Spread a large frame whose scan yields fewer splits than task slots.

    A single large row group cannot be split by the file source, so every
    downstream stage would run as one task. On a cluster reading many files
    the scan already has enough splits and this is a no-op. Column pruning
    and filters still reach the scan below the exchange. Rows are spread by
    a hash of their scan position, which needs no column and (unlike
    round-robin) no sort to be repeatable on retry.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if scan_partitions(df) >= want:
        return df
    # small inputs finish faster in one task than through an extra shuffle
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= min_bytes:
        return df.repartition(want, F.monotonically_increasing_id())
    return df


def read_parquet_table(spark: SparkSession, path: str, min_partitions: int | None = None,
                       spread_input: bool | None = None) -> DataFrame:
    if spread_input is None:
        spread_input = os.environ.get("SIFT_SPREAD_INPUT", "1") != "0"
    df = spark.read.parquet(path)
    return spread(df, min_partitions) if spread_input else df
