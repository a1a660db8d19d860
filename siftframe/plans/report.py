"""Full insight report (F9): every statistic, series and sentence of one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftframe.operators.correlation import correlation_matrix, significant_pairs
from siftframe.operators.histogram import distribution_rows, histogram_rows
from siftframe.operators.narrative import chart_catalog, insight_sentences
from siftframe.operators.series import bar_series, line_series, scatter_sample
from siftframe.operators.stats import descriptive_stats
from siftframe.plans.facts import gather
from siftframe.session import materialize
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame


SUMMARY_SCHEMA = ("total_rows long, total_columns int, numeric_columns int, categorical_columns int, "
                  "datetime_columns int")


def full_report(df: DataFrame, settings: Settings = DEFAULT, tiebreak: list[str] = (),
                scatter_key: list[str] | None = None, checkpoint: bool = True) -> dict[str, DataFrame]:
    """All report parts as small DataFrames over one materialised input.

    Each statistic is computed once (``plans.facts``) and read by all parts.
    """
    base = materialize(df) if checkpoint else df
    facts = gather(base, settings)
    kinds, known, tops = facts.kinds, facts.known, facts.tops
    stats = descriptive_stats(base, kinds.numeric, settings, facts.numbers)
    pairs = significant_pairs(base, kinds.numeric, settings, known)
    top_pairs = pairs.orderBy("rank").limit(settings.scatter_pairs).collect()
    scatters = [scatter_sample(base, p["col1"], p["col2"], scatter_key, settings=settings)
                .select(F.lit(p["rank"]).alias("pair_rank"), F.lit(p["col1"]).alias("col1"),
                        F.lit(p["col2"]).alias("col2"), "x", "y") for p in top_pairs]
    lines = [line_series(base, t, v, tiebreak, settings, facts.paths[t, v][0])
             .select(F.lit(t).alias("datetime_column"), F.lit(v).alias("value_column"), "*")
             for t in kinds.datetime for v in kinds.numeric[:3]]
    report = {
        "column_types": local_frame(base.sparkSession, 
            [(k, c) for k in ("numeric", "categorical", "datetime") for c in getattr(kinds, k)],
            "kind string, column_name string"),
        "descriptive_stats": stats,
        "correlation": correlation_matrix(base, kinds.numeric, settings, known),
        "significant_pairs": pairs,
        "distributions": distribution_rows(facts.fd_counts),
        "frequency_tables": tops.where(F.col("rank") <= settings.top_n),
        "bar_series": bar_series(base, settings=settings),
        "pie_series": tops.where(F.col("column_name").isin(kinds.categorical[:3]) & (F.col("rank") <= settings.pie_top))
        .select("column_name", "rank", "value", "count"),
        "histogram_series": histogram_rows(facts.chart_counts),
        "charts": chart_catalog(base, settings, known, {p: s[0] for p, s in facts.paths.items()}
                                | {(c,): n for c, n in facts.filled.items()}
                                | {(c,): s["count"] for c, s in facts.numbers.items()}),
        "insights": insight_sentences(base, settings, tiebreak, stats, known, facts.rows, tops, facts.paths),
        "summary": local_frame(base.sparkSession, [(facts.rows, len(base.columns), len(kinds.numeric),
                                                    len(kinds.categorical), len(kinds.datetime))], SUMMARY_SCHEMA),
    }
    if lines:
        out = lines[0]
        for x in lines[1:]:
            out = out.unionByName(x)
        report["line_series"] = out
    if scatters:
        out = scatters[0]
        for x in scatters[1:]:
            out = out.unionByName(x)
        report["scatter"] = out
    return report


def report_rows(report: dict[str, DataFrame]) -> DataFrame:
    """All parts of a report as one long table ``(part, name, item, value)``, to be written as one file.

    ``name`` is the column (or columns) a row is about, ``item`` the statistic, bin, category, position or text.
    """
    def part(key: str, name: Column, item: Column, value: Column | None = None) -> list[DataFrame]:
        if key not in report:
            return []
        return [report[key].select(F.lit(key).alias("part"), name.alias("name"), item.cast("string").alias("item"),
                                   (F.lit(None) if value is None else value).cast("double").alias("value"))]

    def each(key: str, name: Column, columns: list[str]) -> list[DataFrame]:
        cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in columns])
        return [report[key].select(F.lit(key).alias("part"), name.alias("name"), F.inline(cells))]

    column, none = F.col("column_name"), F.lit(None).cast("string")
    parts = [
        *each("summary", none, [f.split()[0] for f in SUMMARY_SCHEMA.split(", ")]),
        *each("descriptive_stats", column, ["count", "mean", "median", "std", "min", "max", "skewness", "kurtosis", "missing_pct"]),
        *part("column_types", column, F.col("kind")),
        *part("correlation", F.concat_ws(",", "col1", "col2"), none, F.col("r")),
        *part("significant_pairs", F.concat_ws(",", "col1", "col2"), F.col("rank"), F.col("correlation")),
        *part("distributions", column, F.concat_ws(" ", "bin", "label"), F.col("count")),
        *part("frequency_tables", column, F.concat_ws(" ", "rank", "value"), F.col("count")),
        *part("pie_series", column, F.concat_ws(" ", "rank", "value"), F.col("count")),
        *part("bar_series", F.concat_ws(",", "cat_column", "num_column"), F.concat_ws(" ", "rank", "category"), F.col("mean")),
        *part("histogram_series", column, F.concat_ws(" ", "bin", "label"), F.col("count")),
        *part("line_series", F.concat_ws(",", "datetime_column", "value_column"), F.concat_ws(" ", "position", "label"), F.col("value")),
        *part("scatter", F.concat_ws(",", "col1", "col2"), F.col("x").cast("decimal(38,4)"), F.col("y")),
        *part("charts", F.concat_ws(" ", "seq", "chart_type"), F.col("title")),
        *part("insights", F.concat_ws(" ", "seq", "kind"), F.col("sentence")),
    ]
    return reduce(DataFrame.unionAll, parts)
