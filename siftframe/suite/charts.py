"""Checks for chart series (E1-E7), the trend and the insight sentences (F1-F8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftframe.operators.correlation import heatmap_cells
from siftframe.operators.narrative import chart_catalog, insight_sentences
from siftframe.operators.series import bar_series, line_series, linear_trend, scatter_sample
from siftframe.plans.report import full_report, report_rows
from siftframe.suite.common import dirty, sql_from, table, union_all
from siftframe.suite.stats import (PART_NUMERIC, _sql_binned, _sql_chart_plan, _sql_corr_cells, _sql_corr_matrix, _sql_fd_plan,
                                   _sql_freq, _sql_pairs, _sql_stats)

EV_NUMERIC = ["event_id", "user_id", "value"]
EV_CATS = ["event_type", "props"]


def q_bar_series(spark, sf):
    return bar_series(table(spark, sf, "events"))


def q_line_series(spark, sf):
    return line_series(table(spark, sf, "events"), "ts", "value", ["event_id"])


def q_scatter_sample(spark, sf):
    return scatter_sample(table(spark, sf, "part"), "p_partkey", "p_retailprice", ["p_partkey"])


def q_heatmap_cells(spark, sf):
    return heatmap_cells(table(spark, sf, "part"))


def q_chart_catalog(spark, sf):
    return chart_catalog(table(spark, sf, "events"))


def q_linear_trend(spark, sf):
    t = linear_trend(table(spark, sf, "events"), "ts", "value", ["event_id"])
    return t.select("datetime_column", "value_column", "n", F.round("slope", 10).alias("slope"),
                    F.round("r2", 6).alias("r2"), "direction")


def q_insight_sentences(spark, sf):
    return insight_sentences(table(spark, sf, "events"), tiebreak=["event_id"])


#: events with a measure that follows another (a scatter chart and a correlation sentence come from it), gaps in both kinds.
LINKED = ["event_id", "ts", "CASE WHEN event_id % 50 = 0 THEN NULL ELSE event_type END AS event_type", "value",
          "CASE WHEN event_id % 31 = 0 THEN NULL ELSE 0 - value * 2 + event_id % 97 END AS echo"]
LINKED_NUMERIC = ["event_id", "value", "echo"]


def q_chart_catalog_part(spark, sf):
    return chart_catalog(table(spark, sf, "part"))


def q_insight_sentences_part(spark, sf):
    return insight_sentences(table(spark, sf, "part"))


def q_full_report_summary(spark, sf):
    """Every part of the report on events, as one long table."""
    report = full_report(dirty(spark, sf, "events", LINKED), tiebreak=["event_id"], scatter_key=["event_id"])
    return report_rows(report).withColumn("value", F.round("value", 4))


QUERIES = {
    "chart_catalog_part": q_chart_catalog_part,
    "insight_sentences_part": q_insight_sentences_part,
    "full_report_summary": q_full_report_summary,
    "bar_series": q_bar_series,
    "line_series": q_line_series,
    "scatter_sample": q_scatter_sample,
    "heatmap_cells": q_heatmap_cells,
    "chart_catalog": q_chart_catalog,
    "linear_trend": q_linear_trend,
    "insight_sentences": q_insight_sentences,
}


def _sql_bar(tbl: str, cats: list[str], nums: list[str]) -> str:
    parts = [f"SELECT '{c}' AS cat_column, '{n}' AS num_column, CAST({c} AS VARCHAR) AS category, "
             f"avg(CAST({n} AS DOUBLE)) AS mean FROM {tbl} WHERE {c} IS NOT NULL GROUP BY 3"
             for c in cats for n in nums]
    return f"""SELECT cat_column, num_column, rank, category, round(mean, 2) AS mean FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cat_column, num_column
         ORDER BY mean DESC NULLS LAST, category) AS INTEGER) AS rank FROM ({union_all(parts)}))
WHERE rank <= 10"""


def _sql_positions(tbl: str, t: str, v: str, tie: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {t}, {tie}) - 1 AS position, {t} AS t, CAST({v} AS DOUBLE) AS y
FROM {tbl} WHERE {t} IS NOT NULL AND {v} IS NOT NULL"""


def _sql_line(tbl: str, t: str, v: str, tie: str) -> str:
    return f"""WITH p AS ({_sql_positions(tbl, t, v, tie)}), n AS (SELECT count(*) AS n FROM p)
SELECT position, strftime(t, '%Y-%m-%d') AS label, y AS value FROM p, n
WHERE n.n >= 2 AND position % (CASE WHEN n.n > 200 THEN n.n // 200 ELSE 1 END) = 0"""


def _sql_trend_row(tbl: str, t: str, v: str, tie: str) -> str:
    return f"""SELECT '{t}' AS datetime_column, '{v}' AS value_column, count(*) AS n,
  regr_slope(y, CAST(position AS DOUBLE)) AS slope,
  CASE WHEN var_pop(y) > 0 THEN regr_r2(y, CAST(position AS DOUBLE)) ELSE 0.0 END AS r2,
  CASE WHEN regr_slope(y, CAST(position AS DOUBLE)) > 0 THEN 'upward' ELSE 'downward' END AS direction
FROM ({_sql_positions(tbl, t, v, tie)}) HAVING count(*) >= 10"""


def _sql_top_pairs(tbl: str, cols: list[str]) -> str:
    return f"""SELECT col1, col2, round(r, 4) AS r4, r,
  row_number() OVER (ORDER BY abs(round(r, 4)) DESC, i, j) AS k
FROM ({_sql_corr_cells(tbl, cols)}) WHERE i < j AND abs(r) >= 0.05"""


def _sql_catalog(tbl: str = "events", nums: list[str] = EV_NUMERIC, cats: list[str] = EV_CATS, times: tuple = ("ts",)) -> str:
    rows = []
    for t in times:
        for j, v in enumerate(nums[:3]):
            rows.append(f"SELECT 0 AS g, {j} AS s, 'line' AS chart_type, '{v} over {t}' AS title, '{t}' AS x, '{v}' AS y "
                        f"FROM {tbl} HAVING count_if({t} IS NOT NULL AND {v} IS NOT NULL) >= 2")
    for i, c in enumerate(cats):
        for j, v in enumerate(nums[:2]):
            rows.append(f"SELECT 1 AS g, {i * 10 + j} AS s, 'bar' AS chart_type, 'mean {v} by {c}' AS title, '{c}' AS x, '{v}' AS y "
                        f"FROM {tbl} HAVING count({c}) > 0")
    for i, c in enumerate(cats):
        rows.append(f"SELECT 2, {i}, 'pie', 'share of {c}', '{c}', NULL FROM {tbl} HAVING count({c}) > 0")
    for j, v in enumerate(nums[:4]):
        rows.append(f"SELECT 3, {j}, 'histogram', 'histogram of {v}', '{v}', NULL FROM {tbl} HAVING count({v}) >= 2")
    rows.append(f"SELECT 4, k, 'scatter', col1 || ' vs ' || col2 || ' (r = ' || printf('%.2f', r4) || ')', col1, col2 "
                f"FROM ({_sql_top_pairs(tbl, nums)}) WHERE k <= 3")
    rows.append("SELECT 5, 0, 'heatmap', 'correlation matrix', NULL, NULL")
    return f"""SELECT CAST(row_number() OVER (ORDER BY g, s) - 1 AS INTEGER) AS seq, chart_type, title, x, y
FROM ({union_all(rows)})"""


def _sql_sentences(tbl: str = "events", nums: list[str] = EV_NUMERIC, cats: list[str] = EV_CATS, times: tuple = ("ts",)) -> str:
    stats = union_all([
        f"""SELECT {i} AS position, '{c}' AS c, round(min(x), 4) AS mn, round(max(x), 4) AS mx,
  round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS med,
  round(CASE WHEN count(x) < 3 THEN NULL WHEN min(x) = max(x) THEN 0.0 ELSE skewness(x) END, 4) AS sk
FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {tbl}) HAVING count(x) > 0""" for i, c in enumerate(nums)])
    freq = union_all([
        f"""SELECT {i} AS position, '{c}' AS c, value, cnt, round(cnt * 100.0 / total, 1) AS pct, uniq FROM (
  SELECT CAST({c} AS VARCHAR) AS value, count(*) AS cnt, sum(count(*)) OVER () AS total,
         count(*) OVER () AS uniq FROM {tbl} WHERE {c} IS NOT NULL GROUP BY 1
  ORDER BY cnt DESC, value LIMIT 1)""" for i, c in enumerate(cats)])
    trends = union_all([_sql_trend_row(tbl, t, v, "event_id") for t in times for v in nums[:2]]) or (
        "SELECT NULL AS datetime_column, NULL AS value_column, NULL AS direction, 0.0 AS r2 WHERE false")
    return f"""WITH st AS ({stats}), fq AS ({freq}), tp AS ({_sql_top_pairs(tbl, nums)}),
tr AS (SELECT row_number() OVER () AS k, * FROM ({trends})),
parts AS (
  SELECT 0 AS g, 0 AS s, 'overview' AS kind, NULL AS column_name,
    format('{{:,}} rows in {len(nums) + len(cats) + len(times)} columns: {len(nums)} numeric, {len(cats)} categorical, {len(times)} datetime.', count(*)) AS sentence
    FROM {tbl}
  UNION ALL
  SELECT 1, position * 2, 'range', c, format('''{{}}'' spans {{:,.2f}} to {{:,.2f}} (mean {{:,.2f}}, median {{:,.2f}}).',
    c, mn, mx, mean, med) FROM st
  UNION ALL
  SELECT 1, position * 2 + 1, 'skewed', c, format('''{{}}'' has a long {{}} tail (skewness {{:.2f}}).',
    c, CASE WHEN sk > 0 THEN 'right' ELSE 'left' END, sk) FROM st WHERE abs(sk) > 1
  UNION ALL
  SELECT 2, 0, 'maximum', c, format('The largest value, {{:,.2f}}, is in ''{{}}''.', mx, c)
    FROM (SELECT * FROM st ORDER BY mx DESC, position LIMIT 1)
  UNION ALL
  SELECT 3, 0, 'correlation', col1 || ',' || col2, format('''{{}}'' and ''{{}}'' move together: {{}} {{}} correlation (r = {{:.2f}}, band {{:.4f}}).',
    col1, col2, CASE WHEN abs(r4) > 0.7 THEN 'strong' ELSE 'moderate' END,
    CASE WHEN r4 > 0 THEN 'positive' ELSE 'negative' END, r4,
    CASE WHEN abs(r) > 0.8 THEN 0.001 ELSE 0.049 END) FROM tp WHERE k = 1
  UNION ALL
  SELECT 4, position, 'top_category', c, format('Most common ''{{}}'' is ''{{}}'' ({{:.1f}}% of values; {{}} distinct).',
    c, value, pct, uniq) FROM fq
  UNION ALL
  SELECT 5, k, 'trend', value_column, format('''{{}}'' trends {{}} along ''{{}}'' (R^2 = {{:.2f}}).',
    value_column, direction, datetime_column, r2) FROM tr)
SELECT CAST(row_number() OVER (ORDER BY g, s) - 1 AS INTEGER) AS seq, kind, column_name, sentence FROM parts"""


def _sql_report(tbl: str, nums: list[str], cats: list[str]) -> str:
    """All parts of the report over ``tbl`` (one time column ``ts``, ties by event_id) as one long table."""
    stats = ["count", "mean", "median", "std", "min", "max", "skewness", "kurtosis", "missing_pct"]
    summary = {"total_rows": "count(*)", "total_columns": len(nums) + len(cats) + 1, "numeric_columns": len(nums),
               "categorical_columns": len(cats), "datetime_columns": 1}

    def part(key: str, name: str, item: str, value: str, source: str) -> str:
        return (f"SELECT '{key}' AS part, {name} AS name, CAST({item} AS VARCHAR) AS item, "
                f"round(CAST({value} AS DOUBLE), 4) AS value FROM ({source})")

    def scatter(i: int, j: int) -> str:
        a, b = nums[i], nums[j]
        return f"""SELECT '{a},{b}' AS name, x, y FROM (
  SELECT CAST({a} AS DOUBLE) AS x, round(CAST({b} AS DOUBLE), 4) AS y FROM {tbl} WHERE {a} IS NOT NULL AND {b} IS NOT NULL
  ORDER BY md5(CAST(event_id AS VARCHAR)) LIMIT 500) WHERE EXISTS (
  SELECT 1 FROM ({_sql_top_pairs(tbl, nums)}) WHERE k <= 3 AND col1 = '{a}' AND col2 = '{b}')"""

    label = "printf('%.2f', g.lower) || '-' || printf('%.2f', g.upper) AS label"
    both = "concat_ws(' ', rank, value)"
    return union_all([
        *[part("summary", "NULL", f"'{k}'", "v", f"SELECT {v} AS v FROM {tbl} LIMIT 1") for k, v in summary.items()],
        *[part("descriptive_stats", "column_name", f"'{k}'", f'"{k}"', _sql_stats(tbl, nums)) for k in stats],
        *[part("column_types", f"'{c}'", f"'{k}'", "NULL", "SELECT 1")
          for k, cs in (("numeric", nums), ("categorical", cats), ("datetime", ["ts"])) for c in cs],
        part("correlation", "col1 || ',' || col2", "NULL", "r", _sql_corr_matrix(tbl, nums)),
        part("significant_pairs", "col1 || ',' || col2", "rank", "correlation", _sql_pairs(tbl, nums)),
        part("distributions", "column_name", "concat_ws(' ', bin, label)", "count", _sql_binned(tbl, nums, _sql_fd_plan(tbl, nums), label)),
        part("frequency_tables", "column_name", both, "count", _sql_freq(tbl, cats, 10)),
        part("pie_series", "column_name", both, "count", _sql_freq(tbl, cats, 7)),
        part("bar_series", "cat_column || ',' || num_column", "concat_ws(' ', rank, category)", "mean", _sql_bar(tbl, cats, nums[:2])),
        part("histogram_series", "column_name", "concat_ws(' ', bin, label)", "count",
             _sql_binned(tbl, nums, _sql_chart_plan(tbl, nums), "printf('%.1f', g.lower) AS label")),
        *[part("line_series", f"'ts,{v}'", "concat_ws(' ', position, label)", "value", _sql_line(tbl, "ts", v, "event_id")) for v in nums],
        *[part("scatter", "name", "CAST(x AS DECIMAL(38, 4))", "y", scatter(i, j)) for j in range(len(nums)) for i in range(j)],
        part("charts", "concat_ws(' ', seq, chart_type)", "title", "NULL", _sql_catalog(tbl, nums, cats)),
        part("insights", "concat_ws(' ', seq, kind)", "sentence", "NULL", _sql_sentences(tbl, nums, cats)),
    ])


ORACLES = {
    "chart_catalog_part": _sql_catalog("part", PART_NUMERIC, ["p_name", "p_brand", "p_type"], ()),
    "insight_sentences_part": _sql_sentences("part", PART_NUMERIC, ["p_name", "p_brand", "p_type"], ()),
    "full_report_summary": _sql_report(sql_from("events", LINKED), LINKED_NUMERIC, ["event_type"]),
    "bar_series": _sql_bar("events", EV_CATS, EV_NUMERIC[:2]),
    "line_series": _sql_line("events", "ts", "value", "event_id"),
    "scatter_sample": """SELECT round(CAST(p_partkey AS DOUBLE), 4) AS x, round(p_retailprice, 4) AS y FROM part
WHERE p_partkey IS NOT NULL AND p_retailprice IS NOT NULL ORDER BY md5(CAST(p_partkey AS VARCHAR)) LIMIT 500""",
    "heatmap_cells": _sql_corr_matrix("part", ["p_partkey", "p_size", "p_retailprice"]),
    "chart_catalog": _sql_catalog(),
    "linear_trend": f"""SELECT datetime_column, value_column, n, round(slope, 10) AS slope, round(r2, 6) AS r2, direction
FROM ({_sql_trend_row('events', 'ts', 'value', 'event_id')})""",
    "insight_sentences": _sql_sentences(),
}
