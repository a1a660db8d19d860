"""Type narrowing and data footprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.classify import is_integral
from siftframe.functions.exprs import q
from siftframe.operators.steplog import LogRow
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame

# Signed integer types from narrowest to widest with their ranges.
INT_TYPES = (
    ("tinyint", -128, 127),
    ("smallint", -32768, 32767),
    ("int", -2147483648, 2147483647),
    ("bigint", -9223372036854775808, 9223372036854775807),
)

_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8, T.FloatType: 4,
          T.DoubleType: 8, T.BooleanType: 1, T.DateType: 4, T.TimestampType: 8,
          T.TimestampNTZType: 8}


def smallest_int_type(lo: int | None, hi: int | None) -> str:
    if lo is None or hi is None:
        return "tinyint"
    for name, a, b in INT_TYPES:
        if a <= lo and hi <= b:
            return name
    return "bigint"


def integer_bound_exprs(df: DataFrame) -> list:
    """min/max of each integral column, aliased ``lo<i>``/``hi<i>``."""
    ints = [f.name for f in df.schema.fields if is_integral(f.dataType)]
    return [e for i, c in enumerate(ints)
            for e in (F.min(q(c)).alias(f"lo{i}"), F.max(q(c)).alias(f"hi{i}"))]


def read_integer_plan(df: DataFrame, row) -> dict[str, tuple[int | None, int | None, str]]:
    ints = [f.name for f in df.schema.fields if is_integral(f.dataType)]
    return {c: (row[f"lo{i}"], row[f"hi{i}"], smallest_int_type(row[f"lo{i}"], row[f"hi{i}"]))
            for i, c in enumerate(ints)}


def integer_plan(df: DataFrame) -> dict[str, tuple[int | None, int | None, str]]:
    """``{column: (min, max, narrowest type)}`` for integral columns, one aggregate."""
    exprs = integer_bound_exprs(df)
    if not exprs:
        return {}
    return read_integer_plan(df, df.agg(*exprs).first())


def narrow_integers(df: DataFrame, plan: dict | None = None) -> tuple[DataFrame, list[LogRow]]:
    """Cast each integral column to the narrowest type holding its min..max.

    Bounds are proven by the aggregate first (or passed in ``plan`` from an
    aggregate the caller already ran), so the ANSI cast cannot overflow.
    """
    plan = integer_plan(df) if plan is None else plan
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = df.select(*[q(c).cast(plan[c][2]).alias(c) if c in plan else q(c) for c in df.columns])
    log = [LogRow("narrow_integers", c, f"{types[c]}->{t}", None)
           for c, (_, _, t) in plan.items() if t != types[c]]
    return out, log


def float_errors(df: DataFrame) -> dict[str, float | None]:
    """Largest |x - float32(x)| over the finite values of each double column."""
    dbl = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)
           and not f.name.startswith("is_outlier_")]
    if not dbl:
        return {}

    def err(c):
        x = q(c)
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
        return F.max(F.when(finite, F.abs(x - x.cast("float").cast("double"))))

    row = df.agg(*[err(c).alias(f"e{i}") for i, c in enumerate(dbl)]).first()
    return {c: row[f"e{i}"] for i, c in enumerate(dbl)}


def narrow_floats(df: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, list[LogRow]]:
    """Double -> float where every value moves by at most ``float_atol``."""
    errs = float_errors(df)
    ok = {c for c, e in errs.items() if e is None or e <= settings.float_atol}
    if not ok:
        return df, []
    out = df.select(*[q(c).cast("float").alias(c) if c in ok else q(c) for c in df.columns])
    return out, [LogRow("narrow_floats", c, "double->float", None) for c in errs if c in ok]


def footprint_exprs(df: DataFrame) -> list:
    """Per column ``b<i>``: rows x width for fixed types, UTF-8 bytes for text."""
    exprs = []
    for i, f in enumerate(df.schema.fields):
        width = _WIDTH.get(type(f.dataType))
        if width is not None:
            e = F.count(F.lit(1)) * F.lit(width)
        elif isinstance(f.dataType, T.DecimalType):
            e = F.count(F.lit(1)) * F.lit(16)
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            e = F.coalesce(F.sum(F.octet_length(q(f.name))), F.lit(0))
        else:
            e = F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(q(f.name))))), F.lit(0))
        exprs.append(e.cast("long").alias(f"b{i}"))
    return exprs


def footprint(df: DataFrame) -> DataFrame:
    """(position, column_name, bytes): rows x width for fixed types, UTF-8
    bytes for text, from one aggregate."""
    fields = df.schema.fields
    exprs = footprint_exprs(df)
    if not exprs:
        return local_frame(df.sparkSession, [], "position int, column_name string, bytes long")
    wide = df.agg(*exprs)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"), F.col(f"b{i}").alias("bytes"))
        for i, f in enumerate(fields)])))
