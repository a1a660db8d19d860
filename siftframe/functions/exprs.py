"""Column-expression helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def q(name: str) -> Column:
    """Column by exact name (dots and spaces allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_double(name: str, dt: T.DataType) -> Column:
    """Numeric value as double; booleans as 0/1; NaN treated as missing."""
    c = q(name)
    if isinstance(dt, T.BooleanType):
        return c.cast("int").cast("double")
    c = c.cast("double")
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def sample_skewness(x: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Bias-corrected skewness (G1) from Spark's population skewness.

    NULL for n < 3, 0 for a constant column, matching pandas.
    """
    g1 = F.skewness(x)
    adj = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(lo == hi, F.lit(0.0))
            .otherwise(adj))


def sample_kurtosis(x: Column, n: Column, lo: Column, hi: Column) -> Column:
    """Bias-corrected excess kurtosis (G2); NULL for n < 4, 0 for constants."""
    g2 = F.kurtosis(x)
    adj = F.try_divide((n - 1) * ((n + 1) * g2 + 6), (n - 2) * (n - 3))
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(lo == hi, F.lit(0.0))
            .otherwise(adj))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson r that is NULL (not an ANSI error) when a side is constant."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def fixed(x: Column, decimals: int) -> Column:
    """``x`` as text with ``decimals`` places, correctly rounded from the binary
    value (like Python's ``f"{x:.2f}"``); no grouping commas."""
    return F.regexp_replace(F.format_number(x, decimals), ",", "")


def round_keep_sign(x: Column, decimals: int) -> Column:
    """``round`` that keeps the sign of a negative value rounded to zero
    (-0.0), as Python/numpy rounding does; Spark's ``round`` gives 0.0."""
    r = F.round(x, decimals)
    return F.when((r == 0) & (x < 0), F.lit(-0.0)).otherwise(r)


def put(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """``df`` with the columns of ``made``: in place where the name exists, else appended."""
    kept = [made[c].alias(c) if c in made else q(c) for c in df.columns]
    return df.select(*kept, *[e.alias(c) for c, e in made.items() if c not in df.columns])
