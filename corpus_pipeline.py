"""A corpus pipeline: each stage calls one text operator and keeps what it lets through.

Rows are judged one by one: copies, near copies and benchmark passages are
found and dropped by a row's own number, so null and repeated doc_ids neither
escape a stage nor take other rows with them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.llm.bpe import digests, encode_documents
from siftframe.llm.common import small_batches, stage, table
from siftframe.llm.decontaminate import contaminated
from siftframe.llm.exact_dedup import exact_duplicates
from siftframe.llm.near_dedup import near_duplicates
from siftframe.llm.toxicity import THRESHOLD, fit, toxicity


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number of its own for each row, written so that it stays, and the name of that column."""
    name = "_row"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return stage(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def _by_number(rows: DataFrame, number: str) -> DataFrame:
    """(doc_id, text) as the operators take it, the row's number as its id."""
    return rows.select(F.col(number).alias("doc_id"), "text")


def _without(rows: DataFrame, number: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without the numbers in ``dropped`` (doc_id), and without the numbers' column."""
    return rows.join(dropped.select(F.col("doc_id").alias(number)).distinct(), number, "left_anti").drop(number)


def _one_each(rows: DataFrame, number: str, groups: DataFrame, keep: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with one row of each of ``groups`` (doc_id: a row's number, group): the one that ``keep`` picks by id and number."""
    members = groups.select(F.col("doc_id").alias("n"), "group").join(
        rows.select(F.col(number).alias("n"), F.col("doc_id").alias("id")), "n")
    members = stage(members, "members")
    kept = members.groupBy("group").agg(keep(F.col("id"), F.col("n")).alias("k")).select(F.col("k.n").alias("n"))
    return _without(rows, number, members.join(kept, "n", "left_anti").select(F.col("n").alias("doc_id")))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the threshold, by a model fitted on the labelled rows of ``docs``."""
    small_batches(spark)
    model = fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity(F.col("text"), model) < THRESHOLD)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: the largest doc_id, a null one only if there is no other."""
    rows, number = _numbered(docs)
    found = exact_duplicates(_by_number(rows, number)).where("group_size > 1").withColumnRenamed("keep_id", "group")
    return _one_each(rows, number, found, lambda i, n: F.max(F.struct(i, n)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate component (five words a shingle, similarity 0.8) one row: the smallest doc_id, null last."""
    rows, number = _numbered(docs)
    found = near_duplicates(_by_number(rows, number)).withColumnRenamed("component_id", "group")
    return _one_each(rows, number, found, lambda i, n: F.min(F.struct(i.isNull(), i, n)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a window like a benchmark item."""
    rows, number = _numbered(docs)
    return _without(rows, number, contaminated(_by_number(rows, number), table(spark, sf_dir, "benchmark")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    return digests(encode_documents(docs.select("doc_id", "text")))


STAGES = [("toxicity", reject_toxic), ("exact_dedup", drop_exact_copies), ("near_dedup", drop_near_copies),
          ("decontaminate", drop_contaminated), ("bpe", encode)]

#: Classification, components and encoding have no SQL form; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
