"""Top-k value counts per categorical column."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftframe.functions.classify import classify
from siftframe.functions.exprs import q
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(ci, column_name, value, count)`` over non-missing values of ``cols``.

    One unpivot (Expand-like generate) and one grouped count with map-side
    partial aggregation: a value holding a third of the rows is collapsed
    before the shuffle.
    """
    cells = [F.struct(F.lit(i).alias("ci"), q(c).cast("string").alias("value")) for i, c in enumerate(cols)]
    names = F.array(*[F.lit(c) for c in cols])
    return (df.select(F.inline(F.array(*cells))).where(F.col("value").isNotNull())
            .groupBy("ci", "value").agg(F.count(F.lit(1)).alias("count"))
            .withColumn("column_name", F.element_at(names, F.col("ci") + 1)))


def frequency_table(df: DataFrame, cols: list[str] | None = None, top: int | None = None,
                    settings: Settings = DEFAULT) -> DataFrame:
    """``(column_name, rank, value, count, percentage, unique_count)``.

    ``top`` most frequent values per column (ties: value ascending), share of
    non-missing values with 1 decimal, and the distinct count. The top-k
    window is limited per partition before its exchange; distinct and total
    counts come from a separate small aggregate, so no task ever holds all
    values of a column.
    """
    cols = classify(df).categorical if cols is None else cols
    top = settings.top_n if top is None else top
    spark = df.sparkSession
    if not cols:
        return local_frame(spark, 
            [], "column_name string, rank int, value string, count long, percentage double, unique_count long")
    vc = value_counts(df, cols)
    w = Window.partitionBy("ci").orderBy(F.desc("count"), F.asc("value"))
    ranked = vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    totals = vc.groupBy("ci").agg(F.count(F.lit(1)).alias("unique_count"), F.sum("count").alias("total"))
    # ``totals`` has one row per column.
    return (ranked.join(F.broadcast(totals), "ci")
            .select("column_name", F.col("rank").cast("int").alias("rank"), "value", "count",
                    F.round(F.col("count") * 100.0 / F.col("total"), 1).alias("percentage"),
                    "unique_count"))


def pie_series(df: DataFrame, cols: list[str] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """``(column_name, rank, value, count)``: top ``pie_top`` values of the first 3 categoricals."""
    cols = classify(df).categorical[:3] if cols is None else cols
    return frequency_table(df, cols, settings.pie_top, settings).select("column_name", "rank", "value", "count")
