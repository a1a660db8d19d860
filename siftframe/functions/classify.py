"""Logical column groups over a Spark schema (numeric / categorical / datetime)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FLAG_PREFIX = "is_outlier_"

_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


@dataclass(frozen=True)
class Classes:
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    datetime: list[str] = field(default_factory=list)
    other: list[str] = field(default_factory=list)

    def kind_of(self, name: str) -> str | None:
        for kind in ("numeric", "categorical", "datetime", "other"):
            if name in getattr(self, kind):
                return kind
        return None


def kind_of_type(dt: T.DataType) -> str:
    if isinstance(dt, _DATETIME):
        return "datetime"
    if isinstance(dt, (*_INTEGRAL, *_FRACTIONAL, T.BooleanType)):
        return "numeric"
    if isinstance(dt, _NESTED):
        return "other"
    return "categorical"


def classify(df: DataFrame) -> Classes:
    """Group columns by kind; outlier flag columns are left out of every group."""
    groups: dict[str, list[str]] = {"numeric": [], "categorical": [], "datetime": [], "other": []}
    for f in df.schema.fields:
        if f.name.startswith(FLAG_PREFIX):
            continue
        groups[kind_of_type(f.dataType)].append(f.name)
    return Classes(**groups)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, _INTEGRAL)


def is_fractional(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def is_boolean(dt: T.DataType) -> bool:
    return isinstance(dt, T.BooleanType)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, T.StringType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, _DATETIME)


def measure_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Numeric columns that can be measured on a number line (no booleans)."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    names = cols if cols is not None else classify(df).numeric
    return [c for c in names if not is_boolean(types[c])]
