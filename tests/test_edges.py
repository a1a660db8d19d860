"""Edge cases: order of fills and drops, null order keys, repeated cleaning, infinities, CSV quoting, date shapes."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftframe.operators.dates import convert_dates, sniff_date_columns
from siftframe.operators.histogram import distribution, fd_bins
from siftframe.operators.impute import impute
from siftframe.operators.series import scatter_sample
from siftframe.plans.ordering import forward_fill
from siftframe.plans.pipeline import clean
from siftframe.settings import Settings
from siftframe.sources.csv import read_csv_table


def day(n):
    return dt.datetime(2024, 1, n)


def test_fill_on_the_left_sees_rows_a_later_column_drops(spark):
    # a: gaps on 10 of 41 rows (filled); b: one gap (dropped) on the row before a gap of a
    rows = [(k, None if k % 4 == 3 else dt.datetime(2024, 2, 1) + dt.timedelta(days=k),
             None if k == 2 else day(1)) for k in range(41)]
    df = spark.createDataFrame(rows, "k long, a timestamp_ntz, b timestamp_ntz")
    out, _ = impute(df, order_by=["k"])
    got = {r.k: r.a for r in out.collect()}
    assert 2 not in got
    assert got[3] == dt.datetime(2024, 2, 1) + dt.timedelta(days=2)


def test_drop_on_the_left_hides_its_rows_from_a_fill(spark):
    rows = [(k, None if k == 2 else day(1), None if k % 4 == 3 else dt.datetime(2024, 2, 1) + dt.timedelta(days=k))
            for k in range(41)]
    df = spark.createDataFrame(rows, "k long, b timestamp_ntz, a timestamp_ntz")
    got = {r.k: r.a for r in impute(df, order_by=["k"])[0].collect()}
    assert got[3] == dt.datetime(2024, 2, 1) + dt.timedelta(days=1)


def test_the_five_percent_edge_fills(spark):
    rows = [(k, None if k == 5 else day(1 + k)) for k in range(20)]  # exactly 5 %
    out, log = impute(spark.createDataFrame(rows, "k long, a timestamp_ntz"), order_by=["k"])
    assert out.count() == 20 and [r.step for r in log] == ["forward_fill"]


@pytest.mark.parametrize("bucket_rows", [10_000, 40])
def test_null_order_keys_come_first_with_any_number_of_buckets(spark, bucket_rows):
    rows = [(None if k % 10 == 0 else k, float(k) if k % 3 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "t int, v double").repartition(4)
    got = sorted(((r.t is not None, r.t or 0), r.v is None) for r in
                 forward_fill(df, ["v"], ["t"], settings=Settings(order_bucket_rows=bucket_rows)).collect())
    first = forward_fill(df, ["v"], ["t"], settings=Settings(order_bucket_rows=10_000)).collect()
    assert got == sorted(((r.t is not None, r.t or 0), r.v is None) for r in first)
    many = forward_fill(df, ["v"], ["t"], settings=Settings(order_bucket_rows=bucket_rows)).where("t is not null")
    assert sorted(map(tuple, many.collect())) == sorted(tuple(r) for r in first if r.t is not None)


def test_clean_runs_on_its_own_output(spark):
    rows = [(k, float(k if k else 900), day(1 + k % 28), 2 + k % 3) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, price double, order_date timestamp_ntz, quantity long")
    once = clean(df, order_by=["id"]).df
    twice = clean(once, order_by=["id"]).df
    assert len(set(twice.columns)) == len(twice.columns)
    assert set(once.columns) <= set(twice.columns)
    same = ["id", "price", "order_date_year", "price_per_unit"]
    assert sorted(map(tuple, twice.select(same).collect())) == sorted(map(tuple, once.select(same).collect()))


def test_a_column_with_an_infinity_has_no_distribution(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"),
                                F.when(F.col("id") == 7, float("inf")).otherwise(F.col("id")).alias("y"))
    assert set(fd_bins(df, ["x", "y"])) == {"x"}
    assert {r.column_name for r in distribution(df).collect()} == {"x"}


def test_scatter_ties_of_the_key_are_broken(spark):
    df = spark.range(2000).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    a, b = (sorted(map(tuple, scatter_sample(df.repartition(n), "x", "y", ["k"]).collect())) for n in (1, 7))
    assert a == b


def test_csv_quotes_backslashes_blanks_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('id,t,n\n1,"He said ""hi""", 2\n2,"C:\\dir\\",3\n3,"two\nlines",4\n')
    rows = read_csv_table(spark, str(path), multi_line=True).orderBy("id").collect()
    assert [r.t for r in rows] == ['He said "hi"', "C:\\dir\\", "two\nlines"]
    assert [r.n for r in rows] == [2, 3, 4]


def test_names_of_the_encoding_audit_are_readable(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes(b"\xef\xbb\xbfid,t\n1,\xc3\xa9\n")
    df = read_csv_table(spark, str(tmp_path / "m.csv"), encoding="utf-8-sig")
    assert df.columns == ["id", "t"] and df.first().t == "é"


@pytest.mark.parametrize("text", [
    "2024-01-05T10:11:12Z", "2024-01-05T12:11:12+02:00", "2024-01-05T10:11:12.000", "2024-01-05 10:11:12.000",
    "01/05/2024 10:11:12"])
def test_timestamp_shapes(spark, text):
    df = spark.createDataFrame([(text,)] * 3, "d string")
    out, _ = convert_dates(df, {c: f for c, (f, _) in sniff_date_columns(df).items()})
    assert out.first().d == dt.datetime(2024, 1, 5, 10, 11, 12)


@pytest.mark.parametrize("text", ["20240105", "Jan 5, 2024", "5-Jan-2024", "5 Jan 2024", "2024-01-05"])
def test_date_shapes(spark, text):
    df = spark.createDataFrame([(text,)] * 3, "d string")
    out, _ = convert_dates(df, {c: f for c, (f, _) in sniff_date_columns(df).items()})
    assert out.first().d == dt.datetime(2024, 1, 5)


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_dates_do_not_depend_on_the_session_zone(spark, zone):
    texts = {"2024-03-10 02:30:00": dt.datetime(2024, 3, 10, 2, 30), "2024-01-05T10:11:12Z": dt.datetime(2024, 1, 5, 10, 11, 12),
             "2024-01-05T10:11:12+02:00": dt.datetime(2024, 1, 5, 8, 11, 12), "2024-11-03 01:30:00.123456": dt.datetime(2024, 11, 3, 1, 30, 0, 123456),
             "1969-12-31T23:59:59.000001": dt.datetime(1969, 12, 31, 23, 59, 59, 1), "2024/01/05 10:11:12": dt.datetime(2024, 1, 5, 10, 11, 12),
             "01/05/2024 03:04:05 PM": dt.datetime(2024, 1, 5, 15, 4, 5), "January 5, 2024": dt.datetime(2024, 1, 5), "5 January 2024": dt.datetime(2024, 1, 5)}
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([tuple(texts)], ", ".join(f"c{i} string" for i in range(len(texts))))
        out, _ = convert_dates(df, {c: f for c, (f, _) in sniff_date_columns(df).items()})
        assert list(out.first()) == list(texts.values())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_histogram_leaves_out_a_column_with_an_infinity(spark):
    from siftframe.operators.histogram import histogram_series
    df = spark.range(50).selectExpr("cast(id as double) as a", "case when id = 3 then double('inf') else cast(id as double) end as b")
    assert {r.column_name for r in histogram_series(df).collect()} == {"a"}
