"""Checks for the cleaning steps and pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftframe.operators.dates import convert_dates, sniff_date_columns
from siftframe.operators.features import date_parts, drop_all_null_columns, infinities_to_null, unit_price
from siftframe.operators.impute import impute
from siftframe.operators.narrow import float_errors, footprint, integer_plan
from siftframe.operators.outliers import flag_outliers, iqr_bounds, outlier_count_frame
from siftframe.operators.tidy import drop_duplicates, standardize_columns, trim_strings
from siftframe.plans.local import local_frame
from siftframe.plans.pipeline import clean, clean_summary
from siftframe.session import shared_folder
from siftframe.sources import read_csv_table, write_table
from siftframe.sources.csv import typed_from_text
from siftframe.suite.common import (LINEITEM_NO_KEYS, SQL_COPIED_LINEITEM, SQL_DIRTY_ORDERS, copied_lineitem, dirty,
                                    dirty_orders, sql_from, table, union_all)

PADDED_PART = [
    "p_partkey",
    "CASE WHEN p_partkey % 5 = 0 THEN 'nan' WHEN p_partkey % 5 = 1 THEN concat(chr(9), ' ', p_name, ' ', chr(10))"
    " ELSE p_name END AS p_name",
    "CASE WHEN p_partkey % 7 = 0 THEN '   ' ELSE concat(p_brand, '  ') END AS p_brand",
    "p_size",
]
GAPPY_QUANTITY = ["l_orderkey", "l_linenumber",
                  "CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity"]
GAPPY_VALUE = ["event_id", "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value"]
GAPPY_PRIORITY = ["o_orderkey", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority"]
FEW_TS_GAPS = ["event_id", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS ts", "value"]
MANY_TS_GAPS = ["event_id", "CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS ts"]
#: few gaps (rows dropped), many (filled), few again, and a measure whose fill follows from the rows left.
LEFT_TO_RIGHT = ["event_id", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS seen",
                 "CASE WHEN event_id % 3 = 0 OR event_id % 40 IN (1, 2) THEN NULL ELSE ts END AS sent",
                 "CASE WHEN event_id % 40 = 1 THEN NULL ELSE ts END AS done",
                 "CASE WHEN event_id % 4 = 0 THEN NULL ELSE value END AS value"]
DATE_TEXT = ["o_orderkey",
             "CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS o_orderdate"]
ISO_TEXT = ["o_orderkey", "CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE concat(CAST(CAST(o_orderdate AS DATE) AS STRING), 'T02:30:12.',"
            " lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0'), 'Z') END AS with_zone",
            "concat(CAST(CAST(o_orderdate AS DATE) AS STRING), ' 02:30:12.', lpad(CAST(o_orderkey % 1000000 AS STRING), 6, '0')) AS no_zone"]
LINEITEM_TEXT = ["CAST(l_orderkey AS STRING) AS l_orderkey", "CAST(l_linenumber AS STRING) AS l_linenumber",
                 "CASE WHEN l_linenumber = 3 THEN 'n/a' ELSE CAST(l_quantity AS STRING) END AS l_quantity",
                 "CASE WHEN l_orderkey % 5 = 0 THEN '' ELSE l_returnflag END AS l_returnflag",
                 "CASE WHEN l_linenumber % 2 = 0 THEN 'True' ELSE 'false' END AS even"]
ORDERS_NOTES = ["o_orderkey", "o_orderstatus", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice",
                "CASE WHEN o_orderkey % 3 = 0 THEN concat(o_orderpriority, chr(10), 'says \"', o_orderstatus, '\", ', chr(10), CAST(o_orderkey AS STRING))"
                " ELSE o_orderpriority END AS note"]
PRICE_QTY = ["l_orderkey", "l_linenumber", "l_extendedprice AS price",
             "CASE WHEN l_orderkey % 11 = 0 THEN 0.0 ELSE l_quantity END AS quantity"]
WITH_INF = ["event_id", "CASE WHEN event_id % 13 = 0 THEN CAST('inf' AS DOUBLE) "
            "WHEN event_id % 17 = 0 THEN CAST('-inf' AS DOUBLE) ELSE value END AS value"]
WITH_EMPTY = ["o_orderkey", "o_orderstatus", "CAST(NULL AS DOUBLE) AS empty_col", "o_totalprice"]


def q_standardize_columns(spark, sf):
    df = table(spark, sf, "region").toDF("R RegionKey", " r-Name! ")
    return standardize_columns(df)[0]


def q_trim_strings(spark, sf):
    return trim_strings(dirty(spark, sf, "part", PADDED_PART))[0]


def q_drop_duplicates(spark, sf):
    return drop_duplicates(dirty(spark, sf, "lineitem", LINEITEM_NO_KEYS))[0]


def q_impute_mean(spark, sf):
    out = impute(dirty(spark, sf, "lineitem", GAPPY_QUANTITY))[0]
    return out.withColumn("l_quantity", F.round("l_quantity", 6))


def q_impute_median(spark, sf):
    return impute(dirty(spark, sf, "events", GAPPY_VALUE))[0]


def q_impute_mode(spark, sf):
    return impute(dirty(spark, sf, "orders", GAPPY_PRIORITY))[0]


def q_drop_missing_datetime(spark, sf):
    return impute(dirty(spark, sf, "events", FEW_TS_GAPS))[0]


def q_forward_fill(spark, sf):
    return impute(dirty(spark, sf, "events", MANY_TS_GAPS), order_by=["event_id"])[0]


def q_impute_left_to_right(spark, sf):
    return impute(dirty(spark, sf, "events", LEFT_TO_RIGHT), order_by=["event_id"])[0]


def q_convert_dates(spark, sf):
    df = dirty(spark, sf, "orders", DATE_TEXT)
    fmts = sniff_date_columns(df)
    return convert_dates(df, {c: f for c, (f, _) in fmts.items()})[0]


def q_convert_dates_iso(spark, sf):
    df = dirty(spark, sf, "orders", ISO_TEXT)
    return convert_dates(df, {c: f for c, (f, _) in sniff_date_columns(df).items()})[0]


def q_typed_from_text(spark, sf):
    return typed_from_text(dirty(spark, sf, "lineitem", LINEITEM_TEXT))


def q_read_csv_breaks(spark, sf):
    """orders with quoted line breaks, written as CSV in the shared folder and read from its splits."""
    target = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    write_table(dirty(spark, sf, "orders", ORDERS_NOTES), target, format="csv")
    return read_csv_table(spark, target)


def q_iqr_bounds(spark, sf):
    b = iqr_bounds(table(spark, sf, "events"))
    return b.select("column_name", *[F.round(c, 6).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


def q_flag_outliers(spark, sf):
    return flag_outliers(table(spark, sf, "events"))[0]


def q_outlier_counts(spark, sf):
    return outlier_count_frame(table(spark, sf, "documents"))


def q_outlier_counts_labels(spark, sf):
    return outlier_count_frame(table(spark, sf, "labels"))


def q_narrow_integers(spark, sf):
    plan = integer_plan(table(spark, sf, "lineitem"))
    return local_frame(spark, [(c, lo, hi, t) for c, (lo, hi, t) in plan.items()],
                                 "column_name string, min long, max long, narrowed_type string")


def q_narrow_floats(spark, sf):
    errs = float_errors(table(spark, sf, "lineitem"))
    df = local_frame(spark, [(c, e) for c, e in errs.items()], "column_name string, max_error double")
    return df.select("column_name", F.round("max_error", 8).alias("max_error"),
                     (F.col("max_error") <= 5e-4).alias("narrowed"))


def q_footprint(spark, sf):
    return footprint(table(spark, sf, "lineitem"))


def q_date_parts(spark, sf):
    return date_parts(table(spark, sf, "orders"))[0]


def q_unit_price(spark, sf):
    return unit_price(dirty(spark, sf, "lineitem", PRICE_QTY))[0]


def q_infinities_to_null(spark, sf):
    return infinities_to_null(dirty(spark, sf, "events", WITH_INF))[0]


def q_drop_all_null_columns(spark, sf):
    return drop_all_null_columns(dirty(spark, sf, "orders", WITH_EMPTY))[0]


def q_clean_pipeline(spark, sf):
    out = clean(dirty_orders(spark, sf)).df
    return out.withColumn("o_totalprice", F.round("o_totalprice", 4))


def q_clean_summary(spark, sf):
    before = dirty_orders(spark, sf)
    return clean_summary(before, clean(before)).drop("steps_applied")


def q_clean_log(spark, sf):
    return clean(dirty_orders(spark, sf)).log


def q_drop_duplicates_wide(spark, sf):
    return drop_duplicates(copied_lineitem(spark, sf))[0]


QUERIES = {
    "standardize_columns": q_standardize_columns,
    "trim_strings": q_trim_strings,
    "drop_duplicates": q_drop_duplicates,
    "drop_duplicates_wide": q_drop_duplicates_wide,
    "impute_mean": q_impute_mean,
    "impute_median": q_impute_median,
    "impute_mode": q_impute_mode,
    "drop_missing_datetime": q_drop_missing_datetime,
    "forward_fill": q_forward_fill,
    "impute_left_to_right": q_impute_left_to_right,
    "convert_dates": q_convert_dates,
    "convert_dates_iso": q_convert_dates_iso,
    "typed_from_text": q_typed_from_text,
    "read_csv_breaks": q_read_csv_breaks,
    "iqr_bounds": q_iqr_bounds,
    "flag_outliers": q_flag_outliers,
    "outlier_counts": q_outlier_counts,
    "outlier_counts_labels": q_outlier_counts_labels,
    "narrow_integers": q_narrow_integers,
    "narrow_floats": q_narrow_floats,
    "footprint": q_footprint,
    "date_parts": q_date_parts,
    "unit_price": q_unit_price,
    "infinities_to_null": q_infinities_to_null,
    "drop_all_null_columns": q_drop_all_null_columns,
    "clean_pipeline": q_clean_pipeline,
    "clean_summary": q_clean_summary,
    "clean_log": q_clean_log,
}


def _sql_trim(x: str) -> str:
    t = f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
    return f"CASE WHEN {t} IN ('nan', 'None', '') THEN NULL ELSE {t} END"


def _sql_fences(tbl: str, cols: list[str]) -> str:
    return union_all([
        f"""SELECT '{c}' AS column_name, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower,
  q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
  quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM {tbl}) WHERE q3 - q1 <> 0""" for c in cols])


def _sql_outlier_counts(tbl: str, cols: list[str]) -> str:
    return union_all([
        f"""SELECT f.column_name, count_if(CAST(t.{c} AS DOUBLE) < f.lower OR CAST(t.{c} AS DOUBLE) > f.upper)
  AS outliers FROM {tbl} t, ({_sql_fences(tbl, [c])}) f GROUP BY f.column_name""" for c in cols])


_LINEITEM_INTS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
_LINEITEM_DBL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_WIDTHS = {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8,
           "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_shipdate": 8}
_LINEITEM_COLS = _LINEITEM_INTS + _LINEITEM_DBL + ["l_returnflag", "l_linestatus", "l_shipdate"]


def _sql_int_type(lo: str, hi: str) -> str:
    return (f"CASE WHEN {lo} >= -128 AND {hi} <= 127 THEN 'tinyint' WHEN {lo} >= -32768 AND {hi} <= 32767 "
            f"THEN 'smallint' WHEN {lo} >= -2147483648 AND {hi} <= 2147483647 THEN 'int' ELSE 'bigint' END")


def _sql_pipeline() -> str:
    """The cleaning pipeline restated as SQL over the same dirty orders."""
    return f"""WITH raw AS (SELECT DISTINCT o_orderkey, o_custkey,
    CASE WHEN trim(o_orderstatus, ' ' || chr(9)) IN ('nan', 'None', '') THEN NULL
         ELSE trim(o_orderstatus, ' ' || chr(9)) END AS o_orderstatus,
    o_totalprice, o_orderdate, o_orderpriority, extra_empty FROM {SQL_DIRTY_ORDERS}),
st AS (SELECT skewness(o_totalprice) AS sk, avg(o_totalprice) AS mean,
    quantile_cont(o_totalprice, 0.5) AS med FROM raw),
md AS (SELECT o_orderpriority AS mode FROM raw WHERE o_orderpriority IS NOT NULL
    GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
imp AS (SELECT o_orderkey, o_custkey, o_orderstatus,
    coalesce(o_totalprice, CASE WHEN abs(st.sk) > 1 THEN st.med ELSE st.mean END) AS o_totalprice,
    try_strptime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
    coalesce(o_orderpriority, md.mode) AS o_orderpriority
  FROM raw, st, md),
f AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM imp)
SELECT CAST(o_orderkey AS SMALLINT) AS o_orderkey, CAST(o_custkey AS SMALLINT) AS o_custkey, o_orderstatus,
  round(o_totalprice, 4) AS o_totalprice, o_orderdate, o_orderpriority,
  CAST(CASE WHEN o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END
       AS TINYINT) AS is_outlier_o_totalprice,
  CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month,
  CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day
FROM imp, f"""


def _sql_summary() -> str:
    p = _sql_pipeline()
    before = ("SELECT count(*) * (8 + 8 + 8 + 8) + coalesce(sum(strlen(o_orderstatus)), 0) "
              "+ coalesce(sum(strlen(o_orderdate)), 0) + coalesce(sum(strlen(o_orderpriority)), 0) AS b "
              f"FROM {SQL_DIRTY_ORDERS}")
    after = ("SELECT count(*) AS n, sum(is_outlier_o_totalprice) AS o, count(*) * (2 + 2 + 8 + 8 + 1 + 4 + 4 + 4) "
             "+ coalesce(sum(strlen(o_orderstatus)), 0) + coalesce(sum(strlen(o_orderpriority)), 0) AS b "
             f"FROM ({p})")
    return f"""WITH b0 AS ({before}), a AS ({after})
SELECT CAST(a.o AS BIGINT) AS outliers_total, CAST(CASE WHEN a.o > 0 THEN 1 ELSE 0 END AS INTEGER) AS outlier_columns,
  a.n AS rows_after, CAST(10 AS INTEGER) AS columns_after, CAST(b0.b AS BIGINT) AS bytes_before,
  CAST(a.b AS BIGINT) AS bytes_after, round((b0.b - a.b) / (1024.0 * 1024.0), 2) AS bytes_saved_mb
FROM b0, a"""


def _sql_log() -> str:
    """The pipeline's step log restated over the same dirty orders."""
    return f"""WITH raw AS (SELECT DISTINCT o_orderkey, o_custkey,
    CASE WHEN trim(o_orderstatus, ' ' || chr(9)) IN ('nan', 'None', '') THEN NULL
         ELSE trim(o_orderstatus, ' ' || chr(9)) END AS o_orderstatus,
    o_totalprice, o_orderdate, o_orderpriority, extra_empty FROM {SQL_DIRTY_ORDERS}),
dup AS (SELECT (SELECT count(*) FROM {SQL_DIRTY_ORDERS}) - count(*) AS removed FROM raw),
st AS (SELECT skewness(o_totalprice) AS sk, count(*) - count(o_totalprice) AS miss_p,
    count(*) - count(o_orderpriority) AS miss_m, min(o_orderkey) AS k0, max(o_orderkey) AS k1,
    min(o_custkey) AS c0, max(o_custkey) AS c1 FROM raw),
p AS ({_sql_pipeline()}),
fl AS (SELECT sum(is_outlier_o_totalprice) AS n FROM p),
steps AS (
  SELECT 0 AS g, 'standardize_columns' AS step, NULL AS column_name, 'renamed' AS strategy, CAST(7 AS BIGINT) AS affected
  UNION ALL SELECT 1, 'trim_strings', NULL, 'trimmed', 3
  UNION ALL SELECT 2, 'drop_duplicates', NULL, 'removed_rows', removed FROM dup WHERE removed > 0
  UNION ALL SELECT 3, 'impute', 'o_totalprice', CASE WHEN abs(sk) > 1 THEN 'median' ELSE 'mean' END, miss_p
    FROM st WHERE miss_p > 0
  UNION ALL SELECT 4, 'impute', 'o_orderpriority', 'mode', miss_m FROM st WHERE miss_m > 0
  UNION ALL SELECT 5, 'convert_dates', 'o_orderdate', 'yyyy-MM-dd', NULL
  UNION ALL SELECT 6, 'flag_outliers', 'o_totalprice', 'iqr', n FROM fl WHERE n > 0
  UNION ALL SELECT 7, 'narrow_integers', 'o_orderkey', 'bigint->' || {_sql_int_type('k0', 'k1')}, NULL FROM st
  UNION ALL SELECT 8, 'narrow_integers', 'o_custkey', 'bigint->' || {_sql_int_type('c0', 'c1')}, NULL FROM st
  UNION ALL SELECT 9, 'optimize_types', NULL, 'done', NULL
  UNION ALL SELECT 10, 'date_parts', 'o_orderdate', 'year_month_day', NULL
  UNION ALL SELECT 11, 'drop_all_null_columns', 'extra_empty', 'dropped', NULL)
SELECT CAST(row_number() OVER (ORDER BY g) - 1 AS INTEGER) AS seq, step, column_name, strategy, affected
FROM steps"""


ORACLES = {
    "clean_log": _sql_log(),
    "standardize_columns": "SELECT r_regionkey, r_name FROM region",
    "trim_strings": f"""SELECT p_partkey, {_sql_trim('p_name')} AS p_name, {_sql_trim('p_brand')} AS p_brand, p_size
FROM {sql_from('part', PADDED_PART)}""",
    "drop_duplicates_wide": f"SELECT DISTINCT * FROM {SQL_COPIED_LINEITEM}",
    "drop_duplicates": f"SELECT DISTINCT * FROM {sql_from('lineitem', LINEITEM_NO_KEYS)}",
    "impute_mean": f"""SELECT l_orderkey, l_linenumber,
  round(coalesce(l_quantity, CASE WHEN abs(skewness(l_quantity) OVER ()) > 1 THEN median(l_quantity) OVER ()
        ELSE avg(l_quantity) OVER () END), 6) AS l_quantity FROM {sql_from('lineitem', GAPPY_QUANTITY)}""",
    "impute_median": f"""SELECT event_id,
  coalesce(value, CASE WHEN abs(skewness(value) OVER ()) > 1 THEN quantile_cont(value, 0.5) OVER ()
        ELSE avg(value) OVER () END) AS value FROM {sql_from('events', GAPPY_VALUE)}""",
    "impute_mode": f"""WITH t AS {sql_from('orders', GAPPY_PRIORITY)},
m AS (SELECT o_orderpriority AS v FROM t WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, m.v) AS o_orderpriority FROM t, m""",
    "drop_missing_datetime": f"SELECT * FROM {sql_from('events', FEW_TS_GAPS)} WHERE ts IS NOT NULL",
    "forward_fill": f"""SELECT event_id, last_value(ts IGNORE NULLS) OVER (ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ts FROM {sql_from('events', MANY_TS_GAPS)}""",
    "impute_left_to_right": f"""WITH filled AS (SELECT event_id, seen, last_value(sent IGNORE NULLS) OVER (ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sent, done, value FROM {sql_from('events', LEFT_TO_RIGHT)} WHERE seen IS NOT NULL)
SELECT event_id, seen, sent, done, coalesce(value, CASE WHEN abs(skewness(value) OVER ()) > 1 THEN quantile_cont(value, 0.5) OVER ()
  ELSE avg(value) OVER () END) AS value FROM filled WHERE done IS NOT NULL""",
    "convert_dates": f"SELECT o_orderkey, try_strptime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM {sql_from('orders', DATE_TEXT)}",
    "convert_dates_iso": f"""SELECT o_orderkey, try_strptime(with_zone, '%Y-%m-%dT%H:%M:%S.%fZ') AS with_zone,
  try_strptime(no_zone, '%Y-%m-%d %H:%M:%S.%f') AS no_zone FROM {sql_from('orders', ISO_TEXT)}""",
    "typed_from_text": """SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
  CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS DOUBLE) END AS l_quantity,
  CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS l_returnflag, l_linenumber % 2 = 0 AS even FROM lineitem""",
    "read_csv_breaks": f"SELECT * FROM {sql_from('orders', ORDERS_NOTES)}",
    "iqr_bounds": f"""SELECT column_name, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lower, 6) AS lower, round(upper, 6) AS upper FROM ({_sql_fences('events', ['event_id', 'user_id', 'value'])})""",
    "flag_outliers": f"""SELECT e.*, CAST(CASE WHEN value < f.lower OR value > f.upper THEN 1 ELSE 0 END AS TINYINT)
  AS is_outlier_value FROM events e, ({_sql_fences('events', ['value'])}) f""",
    "outlier_counts": _sql_outlier_counts("documents", ["doc_id", "n_chars"]),
    "outlier_counts_labels": _sql_outlier_counts("labels", ["doc_id", "quality", "toxic"]),
    "narrow_integers": union_all([
        f"SELECT '{c}' AS column_name, CAST(min({c}) AS BIGINT) AS min, CAST(max({c}) AS BIGINT) AS max, "
        f"{_sql_int_type(f'min({c})', f'max({c})')} AS narrowed_type FROM lineitem" for c in _LINEITEM_INTS]),
    "narrow_floats": union_all([
        f"SELECT '{c}' AS column_name, round(max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))), 8) AS max_error, "
        f"max(abs({c} - CAST(CAST({c} AS FLOAT) AS DOUBLE))) <= 0.0005 AS narrowed FROM lineitem" for c in _LINEITEM_DBL]),
    "footprint": union_all([
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name, "
        + (f"count(*) * {_WIDTHS[c]}" if c in _WIDTHS else f"coalesce(sum(strlen({c})), 0)")
        + " AS bytes FROM lineitem" for i, c in enumerate(_LINEITEM_COLS)]),
    "date_parts": """SELECT *, CAST(year(o_orderdate) AS INTEGER) AS o_orderdate_year,
  CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(day(o_orderdate) AS INTEGER) AS o_orderdate_day
FROM orders""",
    "unit_price": f"SELECT *, price / nullif(quantity, 0) AS price_per_unit FROM {sql_from('lineitem', PRICE_QTY)}",
    "infinities_to_null": f"SELECT event_id, CASE WHEN isinf(value) THEN NULL ELSE value END AS value FROM {sql_from('events', WITH_INF)}",
    "drop_all_null_columns": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "clean_pipeline": _sql_pipeline(),
    "clean_summary": _sql_summary(),
}
