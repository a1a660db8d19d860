"""Physical-plan shape: the scalable forms are the ones Spark runs."""

from siftframe.operators.frequency import frequency_table
from siftframe.plans.ordering import with_position
from siftframe.settings import Settings
from siftframe.suite.common import table


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_topk_is_limited_before_exchange(spark, sf_small):
    txt = plan_text(frequency_table(table(spark, sf_small, "part")))
    assert "WindowGroupLimit" in txt or "TakeOrderedAndProject" in txt


def test_position_window_is_partitioned(spark, sf_small):
    ev = table(spark, sf_small, "events").select("ts", "event_id")
    df = with_position(ev, ["ts", "event_id"], settings=Settings(order_bucket_rows=50))
    txt = plan_text(df)
    # rows are windowed per range bucket; only the per-bucket count table
    # (at most order_buckets rows) is ever gathered into one partition
    assert "Exchange hashpartitioning(_bkt" in txt
    assert "BroadcastHashJoin [_bkt" in txt


def test_line_series_shuffles_the_rows_once(spark, sf_small):
    from siftframe.operators.series import line_series
    ev = table(spark, sf_small, "events")
    third = ev.unionAll(ev.selectExpr("event_id * 0", "timestamp_ntz'2024-03-01'", "user_id", "event_type", "7.5D", "props").toDF(*ev.columns))
    for df in (ev, third):  # with and without copies that outgrow a range
        txt = plan_text(line_series(df, "ts", "value", ["event_id"], Settings(order_bucket_rows=50)))
        shuffles = [line for line in txt.split("\n") if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line]
        # the counts of the ranges and the rows, both by range; copies only ever reach the counts
        assert shuffles and all("hashpartitioning(_bkt" in line for line in shuffles)
        windows = txt.split("row_number() windowspecdefinition(_bkt")
        assert len(windows) == 2


def test_scan_prunes_columns(spark, sf_small):
    from siftframe.operators.profile import missing_counts
    df = missing_counts(table(spark, sf_small, "lineitem").select("l_quantity", "l_tax"))
    txt = plan_text(df)
    assert "ReadSchema: struct<l_quantity:double,l_tax:double>" in txt


def test_bar_means_are_limited_before_exchange(spark, sf_small):
    from siftframe.operators.series import bar_series
    txt = plan_text(bar_series(table(spark, sf_small, "orders")))
    # each partition forwards only its top rows per (categorical, numeric)
    assert txt.count("WindowGroupLimit") >= 2


def test_quantile_select_reuses_grouped_counts(spark, sf_small):
    # the (range, value) count feeds both the cell starts and the ranking:
    # one scan, its exchange reused
    from siftframe.plans import quantiles as Q
    seen = []
    real = Q._select

    def spy(base, ready, bounds, settings=Q.DEFAULT):
        from pyspark.sql.classic.dataframe import DataFrame
        collect = DataFrame.collect

        def keep(self):
            rows = collect(self)
            seen.append(self._jdf.queryExecution().executedPlan().toString())
            return rows
        DataFrame.collect = keep
        try:
            return real(base, ready, bounds, settings)
        finally:
            DataFrame.collect = collect
    Q._select = spy
    try:
        Q.quantiles(table(spark, sf_small, "lineitem"), ["l_quantity", "l_extendedprice"], [0.5])
    finally:
        Q._select = real
    final = seen[0].split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == 1


def test_encoding_audit_is_hash_aggregated(spark):
    import os
    import tempfile
    from siftframe.sources import encoding_audit
    d = tempfile.mkdtemp(prefix="sift-encplan-")
    with open(os.path.join(d, "a.csv"), "wb") as fh:
        fh.write(b"x,y\n1,2\n")
    txt = plan_text(encoding_audit(spark, d))
    # per-file folding never sorts the lines of a file
    assert "HashAggregate" in txt and "SortAggregate" not in txt
    assert "FileScan text" in txt and "content" not in txt.split("FileScan binaryFile")[1].split("\n")[0]


def test_partition_probe_starts_no_job_on_shuffling_frame(spark, sf_small):
    from siftframe.sources.parquet import scan_partitions
    sc = spark.sparkContext
    # (reading a Parquet schema runs a footer job of its own: build the frame first)
    grouped = table(spark, sf_small, "lineitem").groupBy("l_orderkey").count()
    sc.setJobGroup("probe-test", "probe")
    try:
        assert scan_partitions(grouped) > 1000
        assert list(sc.statusTracker().getJobIdsForGroup("probe-test")) == []
    finally:
        sc.setJobGroup(None, None)
