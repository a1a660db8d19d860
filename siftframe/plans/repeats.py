"""Repeated rows of wide tables: fingerprints are shuffled first, whole rows only where one repeats.

The first scan shuffles 16 bytes a row: two 64-bit hashes of all columns and
of which of them are NULL. The fingerprints that occur more than once set bits
in a small bitmap (at most BITS bits, which bounds what is broadcast); the
second scan sends only rows with a set bit on, to be compared by content. Any
repeated row has its bit set, so results never rest on a hash: a fuller bitmap
or two rows of one fingerprint only let more rows through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.exprs import q
from siftframe.session import materialize

WIDE_ROW = 96           # bytes of a row, by its types, from which on fingerprints are worth a second scan
BITS = 1 << 24          # broadcast bound: 262,144 words
BITS_PER_KEY = 16


def _hashable(dt: T.DataType) -> bool:
    if isinstance(dt, T.StructType):
        return all(_hashable(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return _hashable(dt.elementType)
    if isinstance(dt, T.StringType):
        return dt.simpleString() == "string"    # other collations hold unequal texts equal
    return isinstance(dt, (T.NumericType, T.BooleanType, T.BinaryType, T.DateType, T.TimestampType,
                           T.TimestampNTZType))


def is_wide(df: DataFrame) -> bool:
    """Whether rows are wide enough, and of types that hash as they compare."""
    sizes = {T.StringType: 20, T.BinaryType: 100, T.ArrayType: 100, T.StructType: 100}
    width = sum(next((s for t, s in sizes.items() if isinstance(f.dataType, t)), 8) for f in df.schema.fields)
    return width >= WIDE_ROW and all(_hashable(f.dataType) for f in df.schema.fields)


def _names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, made different from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def _fingerprint(df: DataFrame) -> tuple[Column, Column]:
    cols = [q(c) for c in df.columns]
    nulls = F.concat(*[F.when(c.isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return F.xxhash64(nulls, *cols), F.xxhash64(F.lit("second"), *cols, nulls)


def _may_repeat(df: DataFrame) -> tuple[DataFrame, str] | None:
    """``df`` with a boolean column, false only for rows that occur once; None if no fingerprint repeats."""
    first, second = _fingerprint(df)
    twice = materialize(df.select(first.alias("f"), second.alias("g")).groupBy("f", "g")
                        .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("f"))
    keys = twice.count()
    if not keys:
        return None
    bits = 1 << 12
    while bits < min(BITS, keys * BITS_PER_KEY):
        bits *= 2
    spot = lambda h: h.bitwiseAND(F.lit(bits - 1))
    mask = lambda h: F.expr("shiftleft(1L, cast({} & 63 as int))".format(h))
    word, bit, mark, flag = _names(df, "_word", "_bit", "_mark", "_repeats")
    words = (twice.select(F.shiftright(spot(F.col("f")), 6).alias(word), mask("f").alias("m"))
             .groupBy(word).agg(F.bit_or("m").alias(bit)))
    rows = df.withColumn(mark, first).withColumn(word, F.shiftright(spot(F.col(mark)), 6))
    met = rows.join(F.broadcast(words), word, "left")
    hit = F.coalesce(F.col(bit).bitwiseAND(mask(mark)) != 0, F.lit(False))
    return met.select(*[q(c) for c in df.columns], hit.alias(flag)), flag


def repeated_rows(df: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(rows that occur once, rows that may occur more than once, all that do among them); None if no row can."""
    found = _may_repeat(df)
    if not found:
        return None
    rows, flag = found
    return rows.where(~F.col(flag)).drop(flag), rows.where(flag).drop(flag)
