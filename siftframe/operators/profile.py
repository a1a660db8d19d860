"""Table profile: shape, types, missing values, duplicates, input size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.classify import classify, kind_of_type
from siftframe.functions.exprs import q
from siftframe.plans.local import local_frame
from siftframe.plans.repeats import is_wide, repeated_rows


def missing_expr(name: str, dt: T.DataType):
    """Missing test: NULL, or NaN on floating columns."""
    c = q(name)
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def table_shape(df: DataFrame) -> DataFrame:
    """One row: ``n_rows`` (one counting scan) and ``n_columns`` (schema)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).cast("int").alias("n_columns"))


def column_types(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, kind) from the schema; no scan."""
    rows = [(i, f.name, f.dataType.simpleString(), kind_of_type(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return local_frame(df.sparkSession, 
        rows, "position int, column_name string, data_type string, kind string")


def missing_counts(df: DataFrame) -> DataFrame:
    """(position, column_name, missing) from one aggregate, unpivoted to long form."""
    fields = df.schema.fields
    if not fields:
        return local_frame(df.sparkSession, [], "position int, column_name string, missing long")
    wide = df.agg(*[F.count_if(missing_expr(f.name, f.dataType)).alias(f"m{i}")
                    for i, f in enumerate(fields)])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.col(f"m{i}").alias("missing"))
        for i, f in enumerate(fields)])))


def duplicate_count(df: DataFrame) -> DataFrame:
    """One row ``duplicate_rows``: full-row repeats beyond the first (NULLs equal).

    Wide rows are told apart by fingerprint first, and only rows whose
    fingerprint repeats are shuffled whole. Grouping on every column shuffles
    once; partial aggregation collapses a row repeated millions of times
    before the exchange.
    """
    if is_wide(df):
        parts = repeated_rows(df)
        if parts is None:
            return local_frame(df.sparkSession, [(0,)], "duplicate_rows long")
        df = parts[1]
    return repeats_beyond_first(df)


def repeats_beyond_first(df: DataFrame) -> DataFrame:
    cols = [q(c) for c in df.columns]
    return (df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def type_histogram(df: DataFrame) -> DataFrame:
    """(kind, n_columns): columns per kind, as the upload summary shows."""
    kinds = [kind_of_type(f.dataType) for f in df.schema.fields]
    order = ["numeric", "categorical", "datetime", "other"]
    rows = [(k, kinds.count(k)) for k in order if kinds.count(k)]
    return local_frame(df.sparkSession, rows, "kind string, n_columns int")


def _total_missing_agg(df: DataFrame):
    total = F.lit(0).cast("long")
    for f in df.schema.fields:
        total = total + F.count_if(missing_expr(f.name, f.dataType))
    return total


def total_missing(df: DataFrame) -> DataFrame:
    """One row ``total_missing``: all gaps in the table."""
    return df.agg(_total_missing_agg(df).alias("total_missing"))


def input_size(spark: SparkSession, path: str) -> DataFrame:
    """One row ``size_kb``: bytes of the input files / 1024, one decimal.

    Reads file metadata through the binaryFile source without its content.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.agg(F.round(F.sum("length") / 1024.0, 1).alias("size_kb"))


def profile(df: DataFrame) -> DataFrame:
    """Long-form summary ``(metric, value)``: rows, columns, gaps, duplicates.

    Rows and gaps share one scan; duplicates need their own shuffle.
    """
    one = df.agg(F.count(F.lit(1)).alias("rows"), _total_missing_agg(df).alias("missing"))
    out = one.select(F.inline(F.array(
        F.struct(F.lit("rows").alias("metric"), F.col("rows").alias("value")),
        F.struct(F.lit("columns").alias("metric"), F.lit(len(df.columns)).cast("long").alias("value")),
        F.struct(F.lit("missing").alias("metric"), F.col("missing").alias("value")))))
    dups = duplicate_count(df)
    out = out.unionByName(dups.select(F.lit("duplicate_rows").alias("metric"),
                                      F.col("duplicate_rows").alias("value")))
    kinds = classify(df)
    extra = [(f"{k}_columns", len(getattr(kinds, k))) for k in ("numeric", "categorical", "datetime")]
    return out.unionByName(local_frame(df.sparkSession, extra, "metric string, value long"))
