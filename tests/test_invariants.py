"""Property-style invariants: partitioning independence, exact refinement, sums."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siftframe.operators.correlation import correlation_matrix
from siftframe.operators.histogram import distribution
from siftframe.operators.outliers import flag_outliers
from siftframe.operators.tidy import drop_duplicates
from siftframe.plans.ordering import forward_fill, with_position
from siftframe.plans.quantiles import quantiles
from siftframe.settings import Settings
from siftframe.suite.common import table

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_quantiles_refinement_is_exact(spark, sf_small):
    df = table(spark, sf_small, "lineitem")
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    direct = quantiles(df, cols, PROBS)
    forced = quantiles(df, cols, PROBS, Settings(direct_distinct_limit=5, quantile_buckets=8))
    assert direct == forced
    pdf = df.select(*cols).toPandas()
    for c in cols:
        assert direct[c] == pytest.approx([pdf[c].quantile(p) for p in PROBS], rel=1e-12)


def test_quantiles_rank_cells_are_exact(spark, sf_small):
    # ranking split into many value cells (and a hot value) gives the same order statistics
    df = table(spark, sf_small, "lineitem")
    cols = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount"]
    one = quantiles(df, cols, PROBS, Settings(rank_cells=1))
    many = quantiles(df, cols, PROBS, Settings(rank_cells=64, rank_cell_values=2))
    assert one == many
    hot = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit(-2.5)).otherwise(F.col("id") / 7).alias("x"))
    got = quantiles(hot, ["x"], PROBS, Settings(rank_cells=16, rank_cell_values=1))
    pdf = hot.toPandas()
    assert got["x"] == pytest.approx([pdf["x"].quantile(p) for p in PROBS], rel=1e-12)


def test_quantiles_with_infinities_refine_on_finite_range(spark):
    # a large column holding +-inf is cut on its finite range; infinities sit in the edge cells
    df = spark.range(20000).select(
        F.when(F.col("id") % 97 == 0, F.lit(float("inf"))).when(F.col("id") % 89 == 0, F.lit(float("-inf")))
        .otherwise(F.col("id") * 1.5).alias("x"))
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    direct = quantiles(df, ["x"], probs)
    forced = quantiles(df, ["x"], probs, Settings(direct_distinct_limit=50, quantile_buckets=4, rank_cell_values=2))
    assert direct == forced
    assert direct["x"][0] == float("-inf") and direct["x"][-1] == float("inf")
    pdf = df.toPandas()
    assert direct["x"][1:4] == pytest.approx([pdf["x"].quantile(p) for p in probs[1:4]], rel=1e-12)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_quantiles_independent_of_partitioning(spark, sf_small, parts):
    df = table(spark, sf_small, "events")
    base = quantiles(df, ["value"], PROBS)
    assert quantiles(df.repartition(parts), ["value"], PROBS) == base


def test_hot_value_quantile(spark):
    # a third of the rows share one value
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") * 1.0).alias("x"))
    got = quantiles(df, ["x"], PROBS, Settings(direct_distinct_limit=10, quantile_buckets=4))
    pdf = df.toPandas()
    assert got["x"] == pytest.approx([pdf["x"].quantile(p) for p in PROBS])


def test_positions_match_single_window(spark, sf_small):
    ev = table(spark, sf_small, "events").select("ts", "event_id")
    one = with_position(ev, ["ts", "event_id"]).select("event_id", "_pos").collect()
    many = with_position(ev, ["ts", "event_id"], settings=Settings(order_bucket_rows=10, order_buckets=80)) \
        .select("event_id", "_pos").collect()
    tree = with_position(ev, ["ts", "event_id"], settings=Settings(order_bucket_rows=40, order_buckets=30)) \
        .select("event_id", "_pos").collect()
    assert sorted(one) == sorted(many) == sorted(tree)
    assert sorted(p for _, p in one) == list(range(len(one)))


@pytest.mark.parametrize("keys", [["p_name", "p_partkey"], ["p_retailprice", "p_partkey"]])
def test_positions_text_and_double_keys(spark, sf_small, keys):
    # string and double split points travel through the JSON boundary literal
    from pyspark.sql import Window
    part = table(spark, sf_small, "part").select(*keys)
    want = part.withColumn("_ref", F.row_number().over(Window.orderBy(*keys)) - 1)
    got = with_position(part, keys, settings=Settings(order_bucket_rows=3))
    assert got.join(want, keys).where("_pos != _ref").count() == 0
    assert got.count() == part.count()


def test_positions_with_a_step_keep_only_buckets_that_hold_one(spark, sf_small):
    ev = table(spark, sf_small, "events")
    st = Settings(order_bucket_rows=10, order_buckets=1000)
    full = {r["event_id"]: r["_pos"] for r in with_position(ev, ["ts", "event_id"], settings=st).collect()}
    some = {r["event_id"]: r["_pos"] for r in with_position(ev, ["ts", "event_id"], settings=st, step=97).collect()}
    assert some.items() <= full.items() and len(some) < len(full) / 2
    assert {p for p in some.values() if p % 97 == 0} == set(range(0, len(full), 97))


def test_forward_fill_across_buckets(spark, sf_small):
    ev = table(spark, sf_small, "events").select(
        "event_id", F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("ts")).alias("ts"))
    a = forward_fill(ev, ["ts"], ["event_id"]).collect()
    b = forward_fill(ev, ["ts"], ["event_id"], settings=Settings(order_bucket_rows=7, order_buckets=100)).collect()
    assert sorted(a) == sorted(b)
    pdf = ev.toPandas().sort_values("event_id")
    want = {k: (None if pd.isna(v) else v.to_pydatetime()) for k, v in zip(pdf["event_id"], pdf["ts"].ffill())}
    assert {r["event_id"]: r["ts"] for r in a} == want


def test_dedupe_idempotent(spark, sf_small):
    df = table(spark, sf_small, "lineitem").select("l_returnflag", "l_linestatus", "l_tax")
    once, _ = drop_duplicates(df)
    twice, log = drop_duplicates(once)
    assert log == [] and twice.count() == once.count()


def test_histogram_sums_to_n(spark, sf_small):
    df = table(spark, sf_small, "lineitem")
    h = distribution(df).groupBy("column_name").agg(F.sum("count").alias("s")).collect()
    assert all(r["s"] == df.count() for r in h)


def test_correlation_symmetric(spark, sf_small):
    m = {(r["i"], r["j"]): r["r"] for r in correlation_matrix(table(spark, sf_small, "lineitem")).collect()}
    assert all(m[(i, j)] == m[(j, i)] for i, j in m)
    assert all(v is None or abs(v) <= 1 for v in m.values())


def test_flags_match_counts(spark, sf_small):
    out, log, counts = flag_outliers(table(spark, sf_small, "events"))
    for c, n in counts.items():
        assert out.agg(F.sum(f"is_outlier_{c}")).first()[0] == n


def test_correlation_does_not_depend_on_the_number_of_columns(spark, sf_small):
    from siftframe.operators.correlation import correlations
    df = table(spark, sf_small, "lineitem").withColumn("k", F.lit(3.0)).withColumn("tiny", F.col("l_quantity") * 1e-8)
    few = ["l_quantity", "l_tax", "k", "tiny"]
    many = few + ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount"]
    _, a, n1 = correlations(df, few)
    _, b, n2 = correlations(df, many)
    assert n1 == n2 and all(b[p] == r or abs(b[p] - r) < 1e-12 for p, r in a.items() if r is not None)
    assert b[(2, 2)] is None and a[(2, 2)] is None and abs(b[(0, 3)] - 1) < 1e-9


def test_line_and_trend_with_hot_copies(spark):
    # a third of all rows are copies of one (time, value) pair; no tiebreak
    import datetime as dt
    import numpy as np
    from siftframe.operators.series import line_series, linear_trend
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            rows.append((base + dt.timedelta(days=500), 7.5))
        else:
            rows.append((base + dt.timedelta(days=i % 997), float((i * 37) % 101)))
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    st = Settings(order_bucket_rows=40)
    pdf = pd.DataFrame(rows, columns=["ts", "v"]).sort_values(["ts", "v"], kind="stable").reset_index(drop=True)
    n, step = len(pdf), len(pdf) // 200
    want = [(i, pdf["ts"][i].strftime("%Y-%m-%d"), pdf["v"][i]) for i in range(0, n, step)]
    got = sorted(tuple(r) for r in line_series(df, "ts", "v", settings=st).collect())
    assert got == want
    slope, icept = np.polyfit(np.arange(n, dtype=float), pdf["v"].to_numpy(), 1)
    r2 = np.corrcoef(np.arange(n), pdf["v"].to_numpy())[0, 1] ** 2
    tr = linear_trend(df, "ts", "v", settings=st).first()
    assert tr["n"] == n and tr["slope"] == pytest.approx(slope, rel=1e-9) and tr["r2"] == pytest.approx(r2, rel=1e-9)


def test_forward_fill_hot_order_value_is_split(spark):
    # a third of the rows share one order value; ties are ordered by a row hash
    from pyspark.sql import Window
    from siftframe.plans.ordering import bucketed
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(500)).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("payload"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") * 10).alias("x"))
    st = Settings(order_bucket_rows=50)
    got = {r["payload"]: r["x"] for r in forward_fill(df, ["x"], ["k"], settings=st).collect()}
    h = F.xxhash64("k", "payload", "x")
    w = Window.orderBy("k", h).rowsBetween(Window.unboundedPreceding, 0)
    want = {r["payload"]: r["x"] for r in df.select("payload", F.last("x", ignorenulls=True).over(w).alias("x")).collect()}
    assert got == want
    sized = bucketed(df.withColumn("_h", h), ["k", "_h"], st).groupBy("_bkt").count()
    assert sized.agg(F.max("count")).first()[0] < 1000 / 4  # the hot value spans several buckets


@pytest.mark.parametrize("largest", [1e3, 1e30, 1.7e308, float("inf")])
def test_quantiles_take_three_scans_for_any_distribution(spark, largest):
    """The same jobs whatever the largest value: sketch, count, brackets; and the exact values."""
    import numpy as np
    n = 20_000
    df = spark.range(n).select(F.when(F.col("id") == n - 1, F.lit(largest)).otherwise(
        F.pow(F.lit(1.01), F.pmod(F.col("id") * 7919, F.lit(1500)))).alias("x"),
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("hot")).cache()
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    rows = df.toPandas()
    sc = spark.sparkContext
    for limit in (2000, 300):  # brackets ranked by one window, or over range partitions
        sc.setJobGroup(f"quantiles-{limit}-{largest}", "scans")
        try:
            got = quantiles(df, ["x", "hot"], probs, Settings(direct_distinct_limit=limit, quantile_buckets=200))
            jobs = len(sc.statusTracker().getJobIdsForGroup(f"quantiles-{limit}-{largest}"))
        finally:
            sc.setJobGroup(None, None)
        # three scans (sketch, count, brackets) are at most 24 jobs with the stages of their windows, for every distribution
        assert jobs <= 24, jobs
        for c in ("x", "hot"):
            v = np.sort(rows[c].to_numpy())
            for p, g in zip(probs, got[c]):
                h = (n - 1) * p
                lo = int(h)
                assert g == (v[lo] if h == lo else v[lo] + (h - lo) * (v[lo + 1] - v[lo])), (c, p, limit)


def test_quantiles_do_not_trust_the_sketch(spark, monkeypatch):
    """Brackets that miss their ranks on either side still give the exact values."""
    from siftframe.plans import quantiles as Q
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    for at in (10.0, 4900.0):
        monkeypatch.setattr(Q, "_sketch", lambda v, probs, settings, at=at: F.array(*[F.lit(at)] * (2 * len(probs))))
        monkeypatch.setattr(Q, "_counts_and_sketches", lambda df, cols, types, probs, settings, at=at: (
            {c: (5000, 5000, 0.0, 4999.0) for c in cols}, {c: [at] * (2 * len(probs)) for c in cols}))
        for limit in (4999, 100):
            assert quantiles(df, ["x"], [0.1, 0.5], Settings(direct_distinct_limit=limit)) == {"x": [499 + (4999 * 0.1 - 499), 2499.5]}


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_forward_fill_copies_of_one_row_meet_in_no_window(spark, keys):
    """A third of all rows is one row (with a gap); a partition key may be NULL; values as pandas fills them."""
    from siftframe.plans.ordering import bucketed_points
    rows = [(None if i % 2 else "a", 500, -1, None) if i % 3 == 0 else (None if i % 2 else "a", i % 997, i, None if i % 4 else float(i))
            for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k int, payload int, x double").repartition(5)
    st = Settings(order_bucket_rows=50)
    h = F.xxhash64("g", "k", "payload", "x")
    b, hot = bucketed_points(df.withColumn("_h", h), ["k", "_h"], st)
    sizes = {r["_bkt"]: r["count"] for r in b.groupBy("_bkt").count().collect()}
    assert hot and max(n for i, n in sizes.items() if i % 2 == 0) < 200
    assert b.where("payload = -1 and _bkt % 2 = 0").count() == 0
    got = forward_fill(df, ["x"], ["k"], keys, st)
    pdf = df.withColumn("_h", h).toPandas().sort_values(["k", "_h"], kind="stable")
    pdf["x"] = (pdf.assign(g=pdf["g"].fillna("-")).groupby("g")["x"] if keys else pdf["x"]).ffill()

    def plain(frame):
        return sorted((str(r.g if isinstance(r.g, str) else None), r.k, r.payload, -1.0 if pd.isna(r.x) else r.x) for r in frame.itertuples())
    assert plain(got.toPandas()) == plain(pdf)


@pytest.mark.parametrize("edge", [float("nan"), float("-inf"), float("inf"), 0.0, None])
def test_line_and_trend_order_copies_at_the_edges_of_doubles(spark, edge):
    """Copies of an extreme value outgrow a range; a NULL tiebreak is the smallest key."""
    from pyspark.sql import Window
    from siftframe.operators.series import line_series
    df = spark.range(2400).selectExpr("cast(date'2024-01-01' as timestamp_ntz) as t", "id",
                                      "case when id % 2 = 0 then null else id end as tie", "cast(id % 7 as double) as v")
    hot = F.col("id") % 3 == 0
    df = df.select("t", F.when(~hot, F.col("tie")).alias("tie"), F.when(hot, F.lit(edge if edge is not None else 3.0)).otherwise(F.col("v")).alias("v"))
    known = df.where("not isnan(v)")  # NaN is a gap
    want = (known.withColumn("position", F.row_number().over(Window.orderBy("t", "tie", "v")) - 1)
            .where(F.col("position") % (known.count() // 200) == 0).select("position", "v").collect())
    got = line_series(df, "t", "v", ["tie"], Settings(order_bucket_rows=60)).collect()
    assert sorted((r.position, repr(r.value)) for r in got) == sorted((r.position, repr(r.v)) for r in want)
