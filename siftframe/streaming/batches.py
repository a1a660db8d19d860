"""Clean every micro-batch of a stream with the batch pipeline."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from siftframe.functions.exprs import q
from siftframe.plans.pipeline import clean
from siftframe.settings import DEFAULT, Settings
from siftframe.sources.csv import typed_from_text
from siftframe.sources.sinks import write_table


def _widened(kind: T.DataType) -> T.DataType:
    """The type a stream writes: narrowing is decided on one batch's values, so it is undone."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return T.LongType()
    return T.DoubleType() if isinstance(kind, T.FloatType) else kind


def _stable(df: DataFrame, output_path: str) -> DataFrame:
    """``df`` with the column types of the first batch written under ``output_path``.

    The first batch's widened schema is kept in ``output_path/_schema``. Later
    batches are cast to it (a value that does not fit fails the batch), get
    nulls for its columns that they lack, and keep further columns widened.
    """
    spark = df.sparkSession
    path = f"{output_path}/_schema"
    try:
        known = T.StructType.fromJson(json.loads(spark.read.text(path, wholetext=True).first()[0]))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        known = T.StructType([T.StructField(f.name, _widened(f.dataType)) for f in df.schema.fields])
        spark.range(1).select(F.lit(known.json()).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    have = set(df.columns)
    fixed = [(q(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in known.fields]
    more = [q(f.name).cast(_widened(f.dataType)).alias(f.name) for f in df.schema.fields if f.name not in known.names]
    return df.select(*fixed, *more)


def clean_stream(stream: DataFrame, output_path: str, checkpoint_path: str,
                 settings: Settings = DEFAULT, order_by: list[str] | None = None,
                 trigger: dict | None = None, query_name: str | None = None,
                 type_text: bool = True) -> StreamingQuery:
    """Start a query that writes each cleaned micro-batch to
    ``output_path/batch_id=<n>`` (Parquet) and its step log next to it.

    With ``type_text`` each batch first gets the CSV source's missing-token
    and type-inference pass, as an uploaded file would. All batches are
    written with the types of the first one, widened to bigint and double.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the pipeline runs several small jobs over the batch; keep it once
        # instead of re-reading the source for each (a lost block is simply
        # recomputed from the replayable source)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if batch.isEmpty():
                return
            typed = typed_from_text(batch) if type_text else batch
            res = clean(typed, settings, order_by=order_by, checkpoint=False)
            write_table(_stable(res.df, output_path), f"{output_path}/batch_id={batch_id}")
            write_table(res.log, f"{output_path}/_log/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint_path)
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()
