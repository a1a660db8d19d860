"""Sinks (A3/A4): cleaned tables as CSV with header, or Parquet (keeps types)."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame

TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"
TIMESTAMP_NTZ = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
CLEANED_PREFIX = "cleaned_"  # fixed value: output name prefix


def cleaned_name(input_name: str) -> str:
    return CLEANED_PREFIX + posixpath.basename(input_name)


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Write ``df`` as Parquet (default, types survive) or header CSV.

    Executors write their partitions in parallel; Spark's commit protocol
    makes the output appear only when the job succeeds.
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if format == "csv":
        # the default format would cut fractions of a second to milliseconds; quotes are doubled as the reader expects
        (w.option("header", True).option("escape", '"').option("timestampFormat", TIMESTAMP)
         .option("timestampNTZFormat", TIMESTAMP_NTZ).csv(path))
    elif format == "parquet":
        w.parquet(path)
    else:
        w.format(format).save(path)
