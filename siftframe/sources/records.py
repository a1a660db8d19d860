"""CSV records with quoted line breaks, assembled from the lines of a split file.

Whether a line break lies inside quotes depends on everything before it in the
file. Each line maps the state before it (outside or inside a quoted field) to
the state after it; such a map keeps the state, swaps it or sets it, and the
maps of a run of lines compose to one of the same kind. The state after a
line is that of the last line that sets it, swapped by the lines after that
one: a window inside each file split, and one over the splits of a file (one row a
split), so no task reads more than a split.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OUTSIDE, INSIDE = 0, 1


def _closed_fields(delimiter: str) -> str:
    return f'(^|{re.escape(delimiter)})"(?:[^"]|"")*+"'


def state_after(line: Column, delimiter: str, before: int) -> Column:
    """State after ``line`` for the state ``before``: a quote opens a field only where the field begins."""
    outside = line
    if before == INSIDE:
        # up to the quote that closes the field; what follows is no beginning of a field
        outside = F.regexp_replace(line, r'^(?:[^"]|"")*+"', "x")
        still = ~line.rlike(r'^(?:[^"]|"")*+"')
    rest = F.regexp_replace(outside, _closed_fields(delimiter), "$1")
    opened = F.when(rest.rlike(f'(?:^|{re.escape(delimiter)})"'), INSIDE).otherwise(OUTSIDE)
    return F.when(still, INSIDE).otherwise(opened) if before == INSIDE else opened


def _running(rows: DataFrame, part: list[str], order: str) -> DataFrame:
    """``rows`` (zero, one: states after for each state before) with set_to and swaps, up to and including each row.

    set_to is the state that the last row with a constant map gives (null:
    none), swaps the number of swapping rows after it.
    """
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(F.when(F.col("zero") > F.col("one"), 1).otherwise(0)).over(w))
    last = F.last(F.when(F.col("zero") == F.col("one"), F.struct("zero", "_n")), ignorenulls=True).over(w)
    rows = rows.withColumn("_s", last)
    return rows.withColumn("set_to", F.col("_s.zero")).withColumn(
        "swaps", F.col("_n") - F.coalesce(F.col("_s._n"), F.lit(0))).drop("_n", "_s")


def _state(start: Column) -> Column:
    return F.coalesce(F.col("set_to"), start).cast("int").bitwiseXOR(F.col("swaps").cast("int") % 2)


def records(spark: SparkSession, paths: list[str], charset: str, delimiter: str) -> DataFrame:
    """(path, head, record): the CSV records of files in an ASCII-compatible encoding; head marks a file's first.

    Lines that are a record of their own go through as they are; only the
    lines of longer records meet, by the place where the record starts. A
    file that ends inside quotes fails. A carriage return at a record's end goes.
    """
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    lines = spark.read.format("text").option("lineSep", "\n").load(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), value.alias("line"))
    lines = lines.withColumns({"zero": state_after(F.col("line"), delimiter, OUTSIDE), "one": state_after(F.col("line"), delimiter, INSIDE)})
    lines = _running(lines, ["path", "block"], "seq")

    # one row a split: its map, then the state it starts in
    ends = lines.groupBy("path", "block").agg(F.max_by(F.struct("set_to", "swaps"), "seq").alias("e"))
    ends = ends.select("path", "block", "e.*")
    ends = ends.withColumns({"zero": _state(F.lit(OUTSIDE)), "one": _state(F.lit(INSIDE))}).drop("set_to", "swaps")
    ends = _running(ends, ["path"], "block").withColumn("after", _state(F.lit(OUTSIDE)))
    by_file = Window.partitionBy("path").orderBy("block")
    starts = ends.select("path", "block", F.lag("after", 1, OUTSIDE).over(by_file).alias("start"),
                         (F.lead("block").over(by_file).isNull() & (F.col("after") == INSIDE)).alias("unclosed"))

    lines = lines.join(starts, ["path", "block"]).withColumn("after", _state(F.col("start")))
    by_block = Window.partitionBy("path", "block").orderBy("seq")
    lines = lines.withColumn("before", F.coalesce(F.lag("after").over(by_block), F.col("start")))
    lines = lines.where(F.when(F.col("unclosed"), F.raise_error(F.concat(F.lit("a quoted field is not closed in "), F.col("path"))).cast("boolean"))
                        .otherwise(F.lit(True)))
    begins = F.last(F.when(F.col("before") == OUTSIDE, F.col("seq")), ignorenulls=True)
    lines = lines.withColumn("begin", begins.over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
    # a split may begin in a record of an earlier one: the last that begins there
    opened = lines.groupBy("path", "block").agg(F.max("begin").alias("begin"))
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select("path", "block", F.last("begin", ignorenulls=True).over(earlier).alias("carried"))
    lines = lines.join(opened, ["path", "block"]).withColumn("begin", F.coalesce("begin", "carried"))
    lines = lines.select("path", "block", "seq", "line", "begin", "before", "after")
    alone = (F.col("before") == OUTSIDE) & (F.col("after") == OUTSIDE)
    single = lines.where(alone).select("path", (F.col("block") == 0).alias("early"), "begin", F.col("line").alias("record"))
    longer = lines.where(~alone).groupBy("path", "begin").agg(
        F.min("block").alias("block"), F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("l"))  # one record's lines
    longer = longer.select("path", (F.col("block") == 0).alias("early"), "begin", F.array_join("l.line", "\n").alias("record"))
    made = single.union(longer).withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")
    first = made.where("early").groupBy("path").agg(F.min("begin").alias("first"))
    return made.join(first, "path").select("path", (F.col("begin") == F.col("first")).alias("head"), "record")
