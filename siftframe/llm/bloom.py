"""Blocked Bloom filter as a small table: one row of four 64-bit words per block.

A key's hash names one block and one bit in each of its four words, so a
probe is one broadcast lookup. The number of blocks follows the number of
keys up to MAX_BLOCKS, which bounds what is broadcast (rows of 40 bytes);
with more keys the filter lets more rows through, never fewer, and the exact
join behind it decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BLOCKS = 1 << 17
BITS_PER_KEY = 12
LANES = ("_b0", "_b1", "_b2", "_b3")


def _hash(key: Column) -> Column:
    return F.xxhash64(key, F.lit("bloom"))


def _masks(h: str) -> list[Column]:
    return [F.expr(f"shiftleft(1L, cast(shiftrightunsigned({h}, {40 + 6 * i}) & 63 as int))") for i in range(4)]


def build(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Filter over the values of ``key``: rows (_block, _b0.._b3), and the number of blocks."""
    n = keys.count()
    blocks = 64
    while blocks < MAX_BLOCKS and blocks * 256 < n * BITS_PER_KEY:
        blocks *= 2
    h = keys.select(_hash(F.col(key)).alias("_h"))
    made = h.select((F.col("_h").bitwiseAND(blocks - 1)).alias("_block"),
                    *[m.alias(c) for m, c in zip(_masks("_h"), LANES, strict=True)])
    return made.groupBy("_block").agg(*[F.bit_or(c).alias(c) for c in LANES]), blocks


def maybe_in(rows: DataFrame, key: str, filter_: DataFrame, blocks: int) -> DataFrame:
    """Rows whose ``key`` may be among the filter's keys; columns stay as they are."""
    names = rows.columns
    probe = rows.withColumn("_h", _hash(F.col(key))).withColumn("_block", F.col("_h").bitwiseAND(blocks - 1))
    hit = probe.join(F.broadcast(filter_), "_block")
    for mask, lane in zip(_masks("_h"), LANES, strict=True):
        hit = hit.where(F.col(lane).bitwiseAND(mask) == mask)
    return hit.select(*names)


def prefilter(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys`` (a staged table); none that is goes."""
    return maybe_in(rows, key, *build(keys, key))
