"""Checks for profiling and validation."""

from __future__ import annotations

from siftframe.operators.profile import (column_types, duplicate_count, input_size, missing_counts,
                                         profile, table_shape, total_missing, type_histogram)
from siftframe.operators.quality import quality_report
from siftframe.suite.common import (DIRTY_LINEITEM, LINEITEM_NO_KEYS, SQL_COPIED_LINEITEM, SQL_KINDS,
                                    SQL_TYPE_NAMES, copied_lineitem, dirty, sql_from, table, union_all)

QUALITY_INPUT = LINEITEM_NO_KEYS[:4] + ["CAST(NULL AS DOUBLE) AS empty_col"]
_DIRTY_NAMES = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"]


def q_table_shape(spark, sf):
    return table_shape(table(spark, sf, "lineitem"))


def q_column_types(spark, sf):
    return column_types(table(spark, sf, "lineitem"))


def q_type_histogram(spark, sf):
    return type_histogram(table(spark, sf, "lineitem"))


def q_missing_counts(spark, sf):
    return missing_counts(dirty(spark, sf, "lineitem", DIRTY_LINEITEM))


def q_total_missing(spark, sf):
    return total_missing(dirty(spark, sf, "lineitem", DIRTY_LINEITEM))


def q_duplicate_count(spark, sf):
    return duplicate_count(dirty(spark, sf, "lineitem", LINEITEM_NO_KEYS))


def q_duplicate_count_wide(spark, sf):
    return duplicate_count(copied_lineitem(spark, sf))


def q_quality_report(spark, sf):
    return quality_report(dirty(spark, sf, "lineitem", QUALITY_INPUT))


def q_profile(spark, sf):
    return profile(dirty(spark, sf, "lineitem", DIRTY_LINEITEM))


def q_input_size(spark, sf):
    return input_size(spark, f"{sf.rstrip('/')}/lineitem.parquet")


_DL = sql_from("lineitem", DIRTY_LINEITEM)
_NK = sql_from("lineitem", LINEITEM_NO_KEYS)
_QI = sql_from("lineitem", QUALITY_INPUT)

QUERIES = {
    "table_shape": q_table_shape,
    "column_types": q_column_types,
    "type_histogram": q_type_histogram,
    "missing_counts": q_missing_counts,
    "total_missing": q_total_missing,
    "duplicate_count": q_duplicate_count,
    "duplicate_count_wide": q_duplicate_count_wide,
    "quality_report": q_quality_report,
    "profile": q_profile,
    "input_size": q_input_size,
}

ORACLES = {
    "table_shape": """SELECT count(*) AS n_rows,
  (SELECT CAST(count(*) AS INTEGER) FROM information_schema.columns WHERE table_name = 'lineitem') AS n_columns
FROM lineitem""",
    "column_types": f"""SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
  {SQL_TYPE_NAMES} AS data_type, {SQL_KINDS} AS kind
FROM information_schema.columns WHERE table_name = 'lineitem'""",
    "type_histogram": f"""SELECT kind, CAST(count(*) AS INTEGER) AS n_columns FROM (
  SELECT {SQL_KINDS} AS kind FROM information_schema.columns WHERE table_name = 'lineitem') GROUP BY kind""",
    "missing_counts": union_all([
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, count(*) - count({c}) AS missing FROM {_DL}"
        for i, c in enumerate(_DIRTY_NAMES)]),
    "total_missing": "SELECT " + " + ".join(f"(count(*) - count({c}))" for c in _DIRTY_NAMES)
                     + f" AS total_missing FROM {_DL}",
    "duplicate_count": f"""SELECT (SELECT count(*) FROM {_NK}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_NK}))
  AS duplicate_rows""",
    "duplicate_count_wide": f"""SELECT (SELECT count(*) FROM {SQL_COPIED_LINEITEM})
  - (SELECT count(*) FROM (SELECT DISTINCT * FROM {SQL_COPIED_LINEITEM})) AS duplicate_rows""",
    "quality_report": f"""WITH d AS (SELECT (SELECT count(*) FROM {_QI}) AS n,
  (SELECT count(*) FROM {_QI}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_QI})) AS dup)
SELECT 'all_missing' AS "check", 'warning' AS level, 'empty_col' AS column_name, CAST(0 AS BIGINT) AS value,
  'column ''empty_col'' has no values' AS message FROM {_QI} HAVING count(empty_col) = 0
UNION ALL
SELECT 'duplicates', 'warning', NULL, dup,
  format('{{}} duplicate rows ({{:.1f}}% of {{}})', dup, dup * 100.0 / n, n) FROM d WHERE dup > 0""",
    "profile": f"""SELECT 'rows' AS metric, count(*) AS value FROM {_DL}
UNION ALL SELECT 'columns', 6
UNION ALL SELECT 'missing', """ + " + ".join(f"(count(*) - count({c}))" for c in _DIRTY_NAMES) + f""" FROM {_DL}
UNION ALL SELECT 'duplicate_rows', (SELECT count(*) FROM {_DL}) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_DL}))
UNION ALL SELECT 'numeric_columns', 4
UNION ALL SELECT 'categorical_columns', 1
UNION ALL SELECT 'datetime_columns', 1""",
}
