"""Exact duplicates by an extendible-hash index on shared files.

Index entries (key, rows, largest id) hold one row per distinct 64-bit key of
the normalised text. The directory is built the extendible way: a bucket that
holds more than ``capacity`` entries is split by doubling the number of key
bits it is addressed by, so each bucket is a key range (a prefix) with its own
depth. Entries are written by the tasks that own their bucket's range. Only
keys with several rows are looked at again: their texts travel to the owner of
the key, chain under it and are compared byte by byte, copies collapsing to one
row per chain link before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.llm import bloom
from siftframe.llm.common import lower_ascii, stage

MAX_DEPTH = 12     # directory of at most 2**12 buckets: the most that is ever broadcast
CAPACITY = 1 << 16  # entries a bucket holds before it is split; beyond MAX_DEPTH it grows


def _prefix(depth: int) -> F.Column:
    """The leading ``depth`` bits of the key, as a long."""
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, bucket, depth): for every prefix of MAX_DEPTH bits that is used, the bucket that owns it.

    ``bucket`` names prefix and local depth. A bucket is split while it holds
    more than ``capacity`` entries and bits are left.
    """
    cells = stage(entries.groupBy(_prefix(MAX_DEPTH).alias("slot")).agg(F.count("*").alias("load")), "cells")
    levels = cells.select("slot", "load", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftrightunsigned(slot, {MAX_DEPTH} - depth)"))
    loads = levels.groupBy("depth", "prefix").agg(F.sum("load").alias("held"))
    fits = levels.join(loads, ["depth", "prefix"]).where((F.col("held") <= capacity) | (F.col("depth") == MAX_DEPTH))
    leaf = fits.groupBy("slot").agg(F.min(F.struct("depth", "prefix")).alias("leaf"))
    return leaf.select("slot", F.expr("shiftleft(1L, leaf.depth) + leaf.prefix").alias("bucket"),
                       F.col("leaf.depth").alias("depth"))


def _owned(rows: DataFrame, slots: DataFrame) -> DataFrame:
    """``rows`` (with key) and the bucket whose owner they go to; a key that is not indexed is dropped."""
    return rows.withColumn("slot", _prefix(MAX_DEPTH)).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text).

    Texts are equal when identical after lower-casing A-Z; null counts as
    empty. Of equal texts the row with the largest doc_id stays. Rows that
    repeat a doc_id with equal text get the same verdict and each count in
    group_size. Null doc_ids count in group_size but are kept only in a group
    without any id. An empty table gives an empty result.
    """
    norm = docs.select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("norm"))
    norm = norm.withColumn("key", F.xxhash64("norm"))
    rows = stage(norm.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "rows")
    entries = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    entries = stage(entries, "entries")
    slots = stage(directory(entries, capacity), "directory")
    index = _owned(entries, slots)
    index = stage(index.repartition("bucket").sortWithinPartitions("bucket", "key"), "index")

    repeated = index.where("n > 1").select("key")
    chains = _owned(bloom.prefilter(norm, "key", repeated), slots)
    chains = chains.groupBy("bucket", "key", "norm").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
    chains = stage(chains.select("key", F.sha2("norm", 256).alias("sha"), "keep", "size"), "chains")

    out = rows.join(chains.withColumnRenamed("key", "k"),
                    (F.col("key") == F.col("k")) & (F.col("text_sha256") == F.col("sha")), "left")
    keep = F.coalesce("keep", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
                      F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
