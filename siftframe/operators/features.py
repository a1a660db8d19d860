"""Derived columns and final checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.classify import is_datetime, kind_of_type
from siftframe.functions.exprs import q, put
from siftframe.operators.steplog import LogRow

# Names recognised for the unit-price feature, in priority order.
PRICE_NAMES = ("price", "total_price")
QTY_NAMES = ("quantity", "qty")


def date_parts(df: DataFrame) -> tuple[DataFrame, list[LogRow]]:
    """Add ``<col>_year``, ``<col>_month``, ``<col>_day`` for every datetime column (existing ones are replaced)."""
    dts = [f.name for f in df.schema.fields if is_datetime(f.dataType)]
    if not dts:
        return df, []
    made = {f"{c}_{part}": get(q(c)) for c in dts
            for part, get in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))}
    return put(df, made), [LogRow("date_parts", c, "year_month_day", None) for c in dts]


def _find(df: DataFrame, names) -> str | None:
    lower = {}
    for c in df.columns:
        lower[c.lower()] = c  # a later column wins, as a dict comprehension would
    for n in names:
        if n in lower:
            return lower[n]
    return None


def unit_price(df: DataFrame) -> tuple[DataFrame, list[LogRow]]:
    """``price_per_unit = price / quantity`` where quantity is not 0 (else missing)."""
    p, qty = _find(df, PRICE_NAMES), _find(df, QTY_NAMES)
    if not p or not qty:
        return df, []
    types = {f.name: f.dataType for f in df.schema.fields}
    if kind_of_type(types[p]) != "numeric" or kind_of_type(types[qty]) != "numeric":
        return df, []
    num, den = q(p).cast("double"), q(qty).cast("double")
    ppu = F.when(den != 0, F.try_divide(num, den))
    return put(df, {"price_per_unit": ppu}), [LogRow("unit_price", "price_per_unit", f"{p}/{qty}", None)]


def final_count_exprs(df: DataFrame) -> list:
    """Per column: infinite values (``i<i>``) and finite values (``v<i>``)."""
    exprs = []
    for i, f in enumerate(df.schema.fields):
        c = q(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            inf = F.abs(c) == F.lit(float("inf"))
            exprs += [F.count_if(inf).alias(f"i{i}"),
                      F.count_if(c.isNotNull() & ~F.isnan(c) & ~inf).alias(f"v{i}")]
        else:
            exprs += [F.lit(0).cast("long").alias(f"i{i}"), F.count(c).alias(f"v{i}")]
    return exprs


def read_final_counts(df: DataFrame, row) -> tuple[dict[str, int], dict[str, int]]:
    fields = df.schema.fields
    return ({f.name: row[f"i{i}"] for i, f in enumerate(fields)},
            {f.name: row[f"v{i}"] for i, f in enumerate(fields)})


def final_counts(df: DataFrame) -> tuple[dict[str, int], dict[str, int]]:
    """(infinite values per float column, finite values per column) in one aggregate."""
    exprs = final_count_exprs(df)
    if not exprs:
        return {}, {}
    return read_final_counts(df, df.agg(*exprs).first())


def infinities_to_null(df: DataFrame, infs: dict[str, int] | None = None) -> tuple[DataFrame, list[LogRow]]:
    """Count +-inf in float columns and set them missing."""
    infs = infs if infs is not None else final_counts(df)[0]
    total = sum(infs.values())
    if not total:
        return df, []
    out = df.select(*[
        F.when(F.abs(q(c)) != F.lit(float("inf")), q(c)).alias(c) if infs.get(c) else q(c)
        for c in df.columns])
    return out, [LogRow("infinities_to_null", None, "replaced", total)]


def drop_all_null_columns(df: DataFrame, values: dict[str, int] | None = None) -> tuple[DataFrame, list[LogRow]]:
    """Drop columns without a single (finite) value."""
    values = values if values is not None else final_counts(df)[1]
    empty = [c for c in df.columns if values.get(c, 0) == 0]
    if not empty:
        return df, []
    keep = [q(c) for c in df.columns if c not in empty]
    return df.select(*keep), [LogRow("drop_all_null_columns", c, "dropped", None) for c in empty]
