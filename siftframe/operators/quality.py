"""Data-quality checks (B7-B11): empty input error and warning rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.exprs import q
from siftframe.operators.profile import missing_expr
from siftframe.plans.local import local_frame

REPORT_SCHEMA = "check string, level string, column_name string, value long, message string"


def check_not_empty(df: DataFrame) -> None:
    """Raise ValueError when the table has no columns or no rows."""
    if not df.columns:
        raise ValueError("input has no columns")
    if df.isEmpty():
        raise ValueError("input has no rows")


def quality_report(df: DataFrame) -> DataFrame:
    """Warning rows ``(check, level, column_name, value, message)``.

    * ``all_missing`` - one row per column without any value;
    * ``single_column`` - the table has one column (delimiter problem?);
    * ``duplicates`` - full-row duplicates beyond the first, with share.

    Two jobs: one aggregate for row and per-column counts (which also
    raises on an empty input), one grouped count for duplicates. Output is bounded by the number of columns.
    """
    if not df.columns:
        raise ValueError("input has no columns")
    fields = df.schema.fields
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(~missing_expr(f.name, f.dataType)).alias(f"c{i}") for i, f in enumerate(fields)]).first()
    if counts["rows"] == 0:  # B7, from the same aggregate
        raise ValueError("input has no rows")
    rows = []
    for i, f in enumerate(fields):
        if counts[f"c{i}"] == 0:
            rows.append(("all_missing", "warning", f.name, 0,
                         f"column '{f.name}' has no values"))
    if len(fields) == 1:
        rows.append(("single_column", "warning", fields[0].name, 1,
                     "only one column was found; the delimiter may be wrong"))
    dup = (df.groupBy(*[q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
           .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("d")).first()["d"])
    if dup > 0:
        pct = dup / counts["rows"] * 100
        rows.append(("duplicates", "warning", None, int(dup),
                     f"{dup} duplicate rows ({pct:.1f}% of {counts['rows']})"))
    return local_frame(df.sparkSession, rows, REPORT_SCHEMA)
