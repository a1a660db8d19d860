"""Checks for the statistics operators."""

from __future__ import annotations

from siftframe.functions.binning import sql_bin_index
from siftframe.operators.correlation import correlation_matrix, significant_pairs
from siftframe.operators.frequency import frequency_table, pie_series
from siftframe.operators.histogram import distribution, fd_bin_count, histogram_series
from siftframe.operators.stats import descriptive_stats
from siftframe.suite.common import dirty, sql_from, table, union_all

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                    "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_NUMERIC = ["p_partkey", "p_size", "p_retailprice"]
EVENTS_MEASURES = ["event_id", "user_id", "value"]


def _sql_stats(tbl: str, cols: list[str]) -> str:
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS column_name,
  count(x) AS count, round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median,
  round(stddev_samp(x), 4) AS std, round(min(x), 4) AS min, round(max(x), 4) AS max,
  round(CASE WHEN count(x) < 3 THEN NULL WHEN min(x) = max(x) THEN 0.0 ELSE skewness(x) END, 4) AS skewness,
  round(CASE WHEN count(x) < 4 THEN NULL WHEN min(x) = max(x) THEN 0.0 ELSE kurtosis(x) END, 4) AS kurtosis,
  round((count(*) - count(x)) * 100.0 / count(*), 2) AS missing_pct
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {tbl}) HAVING count(x) > 0""")
    return union_all(parts)


def _sql_corr_cells(tbl: str, cols: list[str]) -> str:
    """All (i, j) cells over rows complete in every column."""
    sub = f"(SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM {tbl} WHERE " + \
          " AND ".join(f"{c} IS NOT NULL" for c in cols) + ")"
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if i == j:
                r = f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END"
            else:
                x, y = (a, b) if i < j else (b, a)
                r = (f"CASE WHEN stddev_samp({x}) > 0 AND stddev_samp({y}) > 0 "
                     f"THEN covar_samp({x}, {y}) / (stddev_samp({x}) * stddev_samp({y})) END")
            parts.append(f"SELECT CAST({i} AS INTEGER) AS i, CAST({j} AS INTEGER) AS j, '{a}' AS col1, "
                         f"'{b}' AS col2, {r} AS r, count(*) AS n FROM {sub}")
    return union_all(parts)


def _sql_corr_matrix(tbl: str, cols: list[str]) -> str:
    return f"SELECT i, j, col1, col2, round(r, 4) AS r FROM ({_sql_corr_cells(tbl, cols)})"


def _sql_pairs(tbl: str, cols: list[str]) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY abs(round(r, 4)) DESC, i, j) AS INTEGER) AS rank,
  col1, col2, round(r, 4) AS correlation,
  CASE WHEN abs(r) > 0.8 THEN 0.001 ELSE 0.049 END AS p_band, n,
  CASE WHEN n > 2 AND 1 - r * r > 1e-12 THEN round(r * sqrt(n - 2) / sqrt(1 - r * r), 4) END AS t_stat
FROM ({_sql_corr_cells(tbl, cols)}) WHERE i < j AND abs(r) >= 0.05"""


def _sql_ranges(tbl: str, cols: list[str], quartiles: bool) -> str:
    parts = []
    for c in cols:
        qs = (", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3" if quartiles else "")
        parts.append(f"SELECT '{c}' AS column_name, count(x) AS n, min(x) AS lo, max(x) AS hi{qs} "
                     f"FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {tbl})")
    return union_all(parts)


def _sql_fd_plan(tbl: str, cols: list[str]) -> str:
    return f"""SELECT column_name, n, lo, hi, q3 - q1 AS iqr,
  CAST(least(CASE WHEN q3 - q1 > 0
       THEN greatest(1, ceil((hi - lo) / (2 * (q3 - q1) * pow(CAST(n AS DOUBLE), CAST(-1 AS DOUBLE) / 3))))
       ELSE greatest(1, floor(sqrt(CAST(n AS DOUBLE)))) END, 50) AS INTEGER) AS k
FROM ({_sql_ranges(tbl, cols, True)}) WHERE n >= 2"""


def _sql_chart_plan(tbl: str, cols: list[str]) -> str:
    return f"""SELECT column_name, n, lo, hi,
  CAST(least(30, greatest(5, floor(sqrt(CAST(n AS DOUBLE))))) AS INTEGER) AS k
FROM ({_sql_ranges(tbl, cols, False)}) WHERE n >= 2"""


def _sql_binned(tbl: str, cols: list[str], plan_sql: str, label_sql: str) -> str:
    vals = union_all([f"SELECT '{c}' AS column_name, CAST({c} AS DOUBLE) AS x FROM {tbl}" for c in cols])
    wlo = "(CASE WHEN p.lo = p.hi THEN p.lo - 0.5 ELSE p.lo END)"
    whi = "(CASE WHEN p.lo = p.hi THEN p.hi + 0.5 ELSE p.hi END)"
    k = "p.k"

    def e(i):
        return f"(CASE WHEN ({i}) >= {k} THEN {whi} ELSE CAST({i} AS DOUBLE) * (({whi} - {wlo}) / {k}) + {wlo} END)"

    return f"""WITH p AS ({plan_sql}),
v AS ({vals}),
c AS (SELECT v.column_name, {sql_bin_index('v.x', wlo, whi, k)} AS bin, count(*) AS cnt
      FROM v JOIN p ON v.column_name = p.column_name WHERE v.x IS NOT NULL GROUP BY 1, 2),
g AS (SELECT p.*, CAST(b.bin AS INTEGER) AS bin, {e('b.bin')} AS lower, {e('b.bin + 1')} AS upper
      FROM p, LATERAL (SELECT range AS bin FROM range(p.k)) b)
SELECT g.column_name, g.bin, g.lower, {label_sql}, CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM g LEFT JOIN c ON g.column_name = c.column_name AND g.bin = c.bin"""


def _sql_freq(tbl: str, cols: list[str], top: int, extra: bool = True) -> str:
    vals = union_all([f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value FROM {tbl}" for c in cols])
    tail = (", round(count * 100.0 / total, 1) AS percentage, unique_count" if extra else "")
    return f"""WITH v AS ({vals}),
c AS (SELECT column_name, value, count(*) AS count FROM v WHERE value IS NOT NULL GROUP BY 1, 2),
t AS (SELECT column_name, count(*) AS unique_count, sum(count) AS total FROM c GROUP BY 1),
r AS (SELECT c.*, CAST(row_number() OVER (PARTITION BY column_name ORDER BY count DESC, value) AS INTEGER) AS rank FROM c)
SELECT r.column_name, r.rank, r.value, r.count{tail}
FROM r JOIN t USING (column_name) WHERE r.rank <= {top}"""


def q_descriptive_stats(spark, sf):
    return descriptive_stats(table(spark, sf, "lineitem"))


def q_correlation_matrix(spark, sf):
    return correlation_matrix(table(spark, sf, "part"))


def q_significant_pairs(spark, sf):
    return significant_pairs(table(spark, sf, "part"))


def q_fd_bin_count(spark, sf):
    from pyspark.sql import functions as F
    return fd_bin_count(table(spark, sf, "lineitem")).select(
        "column_name", "n", F.round("iqr", 4).alias("iqr"), F.round("min", 4).alias("min"),
        F.round("max", 4).alias("max"), "n_bins")


def q_distribution(spark, sf):
    return distribution(table(spark, sf, "lineitem")).drop("upper")


def q_histogram_series(spark, sf):
    return histogram_series(table(spark, sf, "events"))


def q_frequency_table(spark, sf):
    return frequency_table(table(spark, sf, "orders"))


def q_frequency_table_part(spark, sf):
    return frequency_table(table(spark, sf, "part"))


def q_pie_series(spark, sf):
    return pie_series(table(spark, sf, "part"))


#: events with one measure spoilt by a single infinity.
ONE_INF = ["value", "CASE WHEN event_id = 7 THEN CAST('inf' AS DOUBLE) ELSE value * 2 END AS spoilt", "CAST(event_id AS DOUBLE) / 4 AS scaled"]

FINITE = sql_from("events", [ONE_INF[0], ONE_INF[2]])


def q_histogram_inf(spark, sf):
    return histogram_series(dirty(spark, sf, "events", ONE_INF))


def q_distribution_inf(spark, sf):
    return distribution(dirty(spark, sf, "events", ONE_INF)).drop("upper")


#: lineitem measures and columns derived from them: gaps, a constant, a far offset, an exact mirror.
WIDE = [*LINEITEM_NUMERIC, "l_extendedprice / l_quantity AS unit", "l_quantity * l_discount AS saved",
        "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax * 100 END AS gappy", "CAST(7 AS DOUBLE) AS fixed",
        "l_extendedprice + 1000000 AS far", "0 - l_extendedprice AS mirrored"]
WIDE_NAMES = [c.split(" AS ")[-1] for c in WIDE[:11]] + ["fixed", "far", "mirrored"]


def q_correlation_wide(spark, sf):
    return correlation_matrix(dirty(spark, sf, "lineitem", WIDE))


QUERIES = {
    "descriptive_stats": q_descriptive_stats,
    "correlation_matrix": q_correlation_matrix,
    "correlation_wide": q_correlation_wide,
    "significant_pairs": q_significant_pairs,
    "fd_bin_count": q_fd_bin_count,
    "distribution": q_distribution,
    "histogram_series": q_histogram_series,
    "histogram_inf": q_histogram_inf,
    "distribution_inf": q_distribution_inf,
    "frequency_table": q_frequency_table,
    "frequency_table_part": q_frequency_table_part,
    "pie_series": q_pie_series,
}

ORACLES = {
    "descriptive_stats": _sql_stats("lineitem", LINEITEM_NUMERIC),
    "correlation_matrix": _sql_corr_matrix("part", PART_NUMERIC),
    "correlation_wide": _sql_corr_matrix(sql_from("lineitem", WIDE), WIDE_NAMES),
    "significant_pairs": _sql_pairs("part", PART_NUMERIC),
    "fd_bin_count": f"""SELECT column_name, n, round(iqr, 4) AS iqr, round(lo, 4) AS min,
  round(hi, 4) AS max, k AS n_bins FROM ({_sql_fd_plan('lineitem', LINEITEM_NUMERIC)})""",
    "distribution": _sql_binned(
        "lineitem", LINEITEM_NUMERIC, _sql_fd_plan("lineitem", LINEITEM_NUMERIC),
        "printf('%.2f', g.lower) || '-' || printf('%.2f', g.upper) AS label"),
    "histogram_series": _sql_binned(
        "events", EVENTS_MEASURES,
        f"""SELECT column_name, n, lo, hi,
  CAST(least(30, greatest(5, floor(sqrt(CAST(n AS DOUBLE))))) AS INTEGER) AS k
FROM ({_sql_ranges('events', EVENTS_MEASURES, False)}) WHERE n >= 2""",
        "printf('%.1f', g.lower) AS label"),
    "histogram_inf": _sql_binned(
        FINITE, ["value", "scaled"],
        f"""SELECT column_name, n, lo, hi,
  CAST(least(30, greatest(5, floor(sqrt(CAST(n AS DOUBLE))))) AS INTEGER) AS k
FROM ({_sql_ranges(FINITE, ['value', 'scaled'], False)}) WHERE n >= 2""",
        "printf('%.1f', g.lower) AS label"),
    "distribution_inf": _sql_binned(
        FINITE, ["value", "scaled"], _sql_fd_plan(FINITE, ["value", "scaled"]),
        "printf('%.2f', g.lower) || '-' || printf('%.2f', g.upper) AS label"),
    "frequency_table": _sql_freq("orders", ["o_orderstatus", "o_orderpriority"], 10),
    "frequency_table_part": _sql_freq("part", ["p_name", "p_brand", "p_type"], 10),
    "pie_series": _sql_freq("part", ["p_name", "p_brand", "p_type"], 7, extra=False),
}
