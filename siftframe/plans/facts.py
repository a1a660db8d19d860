"""The sufficient statistics of one table, each computed once and read by every part of a report.

One wide aggregate gives moments, bounds and the sums of each (time, value)
pair; one quantile plan gives the quartiles; one grouped count the top values;
one pass over the bins fixed by those numbers fills both kinds of histogram.
What reaches the driver is bounded by the column count (top values stay in a
written table, since they may be long texts).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftframe.functions.classify import Classes, classify
from siftframe.functions.exprs import as_double, q
from siftframe.operators.correlation import correlations
from siftframe.operators.frequency import frequency_table
from siftframe.operators.histogram import binned_counts, chart_bins, fd_bins
from siftframe.operators.stats import moment_exprs
from siftframe.plans.quantiles import quantiles
from siftframe.plans.wide import wide_agg
from siftframe.session import materialize
from siftframe.settings import DEFAULT, Settings


@dataclass
class Facts:
    kinds: Classes
    rows: int
    numbers: dict[str, dict]                    # column -> moments, min, max, q1, median, q3
    paths: dict[tuple[str, str], tuple]         # (time, value) -> (rows with both, mean, population variance)
    filled: dict[str, int]                      # categorical column -> rows with a value
    tops: DataFrame                             # frequency rows down to the longest list any part shows
    known: tuple                                # correlations
    fd: dict[str, tuple]                        # Freedman-Diaconis plan
    fd_counts: DataFrame
    chart_counts: DataFrame


def gather(df: DataFrame, settings: Settings = DEFAULT) -> Facts:
    """All facts of ``df``; a frame that is costly to compute should be written before."""
    kinds = classify(df)
    types = {f.name: f.dataType for f in df.schema.fields}
    per: dict = {c: moment_exprs(as_double(c, types[c])) for c in kinds.numeric}
    per["", "rows"] = [("rows", F.count(F.lit(1)))]
    for t in kinds.datetime:
        for v in kinds.numeric[:3]:
            y = F.when(q(t).isNotNull(), as_double(v, types[v]))
            per[t, v] = [("n", F.count(y)), ("mean", F.avg(y)), ("std", F.var_pop(y))]
    for c in kinds.categorical:
        per["", c, "filled"] = [("n", F.count(q(c)))]
    got = wide_agg(df, per, settings)
    numbers = {c: got[c] for c in kinds.numeric}
    quartiles = quantiles(df, kinds.numeric, [0.25, 0.5, 0.75], settings, counts={
        c: (s["count"], s["count"], s["min"], s["max"]) for c, s in numbers.items()}) if kinds.numeric else {}
    for c, s in numbers.items():
        s["q1"], s["median"], s["q3"] = quartiles[c]
    bounds = {c: (s["count"], s["min"], s["max"], s["q1"], s["q3"]) for c, s in numbers.items()}
    fd, chart = fd_bins(df, kinds.numeric, settings, bounds), chart_bins(df, None, settings, bounds)
    plan = [(c, lo, hi, k) for c, (_, _, lo, hi, k) in fd.items()]
    bins = materialize(binned_counts(df, plan + [(c, *p) for c, p in chart.items()]))
    return Facts(kinds, got["", "rows"]["rows"], numbers,
                 {(t, v): (got[t, v]["n"], got[t, v]["mean"], got[t, v]["std"])
                  for t in kinds.datetime for v in kinds.numeric[:3]},
                 {c: got["", c, "filled"]["n"] for c in kinds.categorical},
                 materialize(frequency_table(df, kinds.categorical, max(settings.top_n, settings.pie_top), settings)),
                 correlations(df, kinds.numeric, settings), fd,
                 bins.where(F.col("ci") < len(plan)), bins.where(F.col("ci") >= len(plan)))
