"""Chart-ready series (E1, E2, E5, E7) and the linear trend."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.classify import classify
from siftframe.functions.exprs import as_double, q, round_keep_sign
from siftframe.plans.ordering import numbered
from siftframe.settings import DEFAULT, Settings
from siftframe.plans.local import local_frame


def _pairs_frame(df: DataFrame, t: str, v: str, tiebreak: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    keep = [q(t), as_double(v, types[v]).alias("_y")] + [q(c) for c in tiebreak if c not in (t, v)]
    return df.select(*keep).where(q(t).isNotNull() & F.col("_y").isNotNull())


def _order(t: str, v: str, tiebreak: list[str]) -> list[str]:
    """Time, tiebreak, value: the value only orders rows the caller left tied
    (the reference leaves their order unspecified), and closes the key with a
    double, so rows equal on it are copies for the chart and the trend."""
    return [t] + [c for c in tiebreak if c not in (t, v)] + ["_y"]


def line_series(df: DataFrame, t: str, v: str, tiebreak: list[str] = (),
                settings: Settings = DEFAULT, n: int | None = None) -> DataFrame:
    """``(position, label, value)``: ``v`` ordered by time; above ``line_max_points``
    rows every (n // line_max_points)-th row from the first is kept.

    The wanted ranks are looked up on range counts: only rows of ranges that
    hold one are shuffled (once) and numbered. Copies that outgrow a range are
    one group, which emits the kept positions that fall inside it (at most
    n / step + 1 rows in total). ``n`` is the number of rows with both values, if known.
    """
    pairs = _pairs_frame(df, t, v, list(tiebreak))
    n = pairs.count() if n is None else n
    if n < 2:
        return local_frame(df.sparkSession, [], "position long, label string, value double")
    step = n // settings.line_max_points if n > settings.line_max_points else 1
    if n > settings.order_bucket_rows:
        # narrower ranges than a sort needs: most of them hold no wanted rank
        most = settings.order_bucket_rows
        settings = replace(settings, order_bucket_rows=max(1, most // 16, min(most, step // 16)))
    pos = numbered(pairs, _order(t, v, list(tiebreak)), [t, "_y"], n, settings, step)
    # first kept position at or after the group's start (integer arithmetic)
    first = F.col("_pos") + (F.lit(step) - F.col("_pos") % F.lit(step)) % F.lit(step)
    last = F.col("_pos") + F.col("_c") - 1
    return (pos.where(first <= last)
            .select(F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("position"),
                    F.date_format(q(t), "yyyy-MM-dd").alias("label"),
                    F.col("_y").alias("value")))


def bar_series(df: DataFrame, cats: list[str] | None = None, nums: list[str] | None = None,
               top: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """``(cat_column, num_column, rank, category, mean)``: group means of the first
    2 numerics by each of the first 3 categoricals, ``top`` largest (ties:
    category ascending; a missing mean sorts last), 2 decimals.

    All categoricals are unpivoted together so one grouped aggregate (with
    partial aggregation) serves every (categorical, numeric) pair.
    """
    kinds = classify(df)
    cats = kinds.categorical[:3] if cats is None else cats
    nums = kinds.numeric[:2] if nums is None else nums
    top = settings.top_n if top is None else top
    spark = df.sparkSession
    if not cats or not nums:
        return local_frame(spark, 
            [], "cat_column string, num_column string, rank int, category string, mean double")
    types = {f.name: f.dataType for f in df.schema.fields}
    numv = [as_double(n, types[n]).alias(f"y{j}") for j, n in enumerate(nums)]
    base = df.select(*[q(c).cast("string").alias(f"c{i}") for i, c in enumerate(cats)], *numv)
    cells = [F.struct(F.lit(i).alias("ci"), F.col(f"c{i}").alias("category"),
                      *[F.col(f"y{j}") for j in range(len(nums))]) for i in range(len(cats))]
    grouped = (base.select(F.inline(F.array(*cells))).where(F.col("category").isNotNull())
               .groupBy("ci", "category").agg(*[F.avg(f"y{j}").alias(f"m{j}") for j in range(len(nums))]))
    long = grouped.select("ci", "category", F.inline(F.array(*[
        F.struct(F.lit(j).alias("ni"), F.col(f"m{j}").alias("mean")) for j in range(len(nums))])))
    w = Window.partitionBy("ci", "ni").orderBy(F.desc_nulls_last("mean"), F.asc("category"))
    cat_names = F.array(*[F.lit(c) for c in cats])
    num_names = F.array(*[F.lit(n) for n in nums])
    return (long.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
            .select(F.element_at(cat_names, F.col("ci") + 1).alias("cat_column"),
                    F.element_at(num_names, F.col("ni") + 1).alias("num_column"),
                    F.col("rank").cast("int").alias("rank"), "category",
                    round_keep_sign(F.col("mean"), 2).alias("mean")))


def scatter_sample(df: DataFrame, x: str, y: str, key: list[str] | None = None,
                   n: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """``(x, y)`` rounded to 4 for rows complete in both; at most ``n`` rows,
    chosen by the smallest md5 of the key (deterministic under any
    partitioning; each partition keeps only its own n before the merge)."""
    n = settings.scatter_points if n is None else n
    types = {f.name: f.dataType for f in df.schema.fields}
    xs, ys = as_double(x, types[x]), as_double(y, types[y])
    if key:
        k = F.md5(F.concat_ws("|", *[q(c).cast("string") for c in key]))
    else:
        # no key: a 64-bit hash of the row (no per-row text building); maps
        # cannot be hashed and are left out
        k = F.xxhash64(*[q(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.MapType)])
    sub = df.select(xs.alias("x"), ys.alias("y"), k.alias("_k")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull())
    return sub.orderBy("_k", "x", "y").limit(n).select(round_keep_sign(F.col("x"), 4).alias("x"),
                                             round_keep_sign(F.col("y"), 4).alias("y"))


def linear_trend(df: DataFrame, t: str, v: str, tiebreak: list[str] = (),
                 settings: Settings = DEFAULT, sums: tuple | None = None) -> DataFrame:
    """``(datetime_column, value_column, n, slope, r2, direction)``: least squares
    of ``v`` on its row position in time order (n >= ``trend_min_rows``).

    R^2 is 0 when ``v`` is constant. ``sums`` are the rows with both values, their mean and population variance, if known.
    """
    spark = df.sparkSession
    schema = "datetime_column string, value_column string, n long, slope double, r2 double, direction string"
    pairs = _pairs_frame(df, t, v, list(tiebreak))
    n, ybar, vy = sums or pairs.agg(F.count(F.lit(1)), F.avg("_y"), F.var_pop("_y")).first()
    if n < settings.trend_min_rows:
        return local_frame(spark, [], schema)
    pos = numbered(pairs, _order(t, v, list(tiebreak)), ["_y"], n, settings)
    # x = row position, centred on its known mean (n - 1) / 2: a group of c
    # copies starting at p adds c * (p - xbar) + c (c - 1) / 2 to sum(x - xbar),
    # and sum((x - xbar)^2) = n (n^2 - 1) / 12 exactly
    c, p = F.col("_c").cast("double"), F.col("_pos").cast("double")
    dx = c * (p - F.lit((n - 1) / 2.0)) + c * (c - 1) / 2
    sxy = pos.agg(F.sum(dx * (F.col("_y") - F.lit(ybar))).alias("sxy")).first()["sxy"] or 0.0
    sxx = n * (n * n - 1) / 12.0
    slope = sxy / sxx
    vy = vy or 0.0
    r2 = (sxy * sxy) / (sxx * n * vy) if vy > 0 else 0.0
    return local_frame(spark, [(t, v, n, slope, r2, "upward" if slope > 0 else "downward")], schema)


def trends(df: DataFrame, tiebreak: list[str] = (), settings: Settings = DEFAULT) -> DataFrame:
    """Trend rows for every datetime column x the first 2 numeric columns."""
    kinds = classify(df)
    parts = [linear_trend(df, t, v, tiebreak, settings)
             for t in kinds.datetime for v in kinds.numeric[:2]]
    if not parts:
        return local_frame(df.sparkSession, 
            [], "datetime_column string, value_column string, n long, slope double, r2 double, direction string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
