"""Hand-checked micro fixtures (FIXTURES.md sections 2 and 3)."""

import math

import pytest
from pyspark.sql import functions as F

from siftframe.functions.names import standard_names
from siftframe.operators.correlation import correlations
from siftframe.operators.dates import convert_dates, sniff_date_columns
from siftframe.operators.features import infinities_to_null, final_counts
from siftframe.operators.histogram import binned_counts
from siftframe.operators.impute import mode_values
from siftframe.operators.outliers import iqr_fences
from siftframe.operators.series import linear_trend
from siftframe.operators.stats import descriptive_stats
from siftframe.operators.tidy import trim_strings
from siftframe.plans.pipeline import clean
from siftframe.plans.quantiles import quantiles

SALES = [
    (1, " Ann ", 10.0, 2, "North", "2024-01-05"),
    (2, "Bob", 20.0, 4, "South", "2024-01-06"),
    (2, "Bob", 20.0, 4, "South", "2024-01-06"),
    (3, "Cy", None, 1, "North", "2024-01-07"),
    (4, "Di", 30.0, 0, None, "2024-01-08"),
    (5, " Ed", 1000.0, 5, "North", "not-a-date"),
    (6, None, 40.0, 8, "South", "2024-01-10"),
    (7, "Flo", 50.0, 10, "East", "2024-01-11"),
]
SALES_COLS = ["Order ID", " Customer Name ", "Price", "Qty", "Region", "Order Date"]


def one_col(spark, values, dtype="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {dtype}")


def stats_row(spark, values):
    return descriptive_stats(one_col(spark, values)).first()


def test_moments(spark):
    r = stats_row(spark, [1.0, 2.0, 3.0, 4.0, 10.0])
    assert r["skewness"] == pytest.approx(1.6971, abs=1e-4)
    assert r["kurtosis"] == pytest.approx(3.152, abs=1e-4)
    assert r["std"] == pytest.approx(3.5355, abs=1e-4)


def test_constant(spark):
    r = stats_row(spark, [5.0] * 4)
    assert (r["std"], r["skewness"], r["kurtosis"]) == (0.0, 0.0, 0.0)
    assert iqr_fences(one_col(spark, [5.0] * 4)) == {}


@pytest.mark.parametrize("n,std,skew,kurt", [(1, None, None, None), (2, "v", None, None), (3, "v", "v", None)])
def test_tiny(spark, n, std, skew, kurt):
    r = stats_row(spark, [float(i) for i in range(1, n + 1)])
    for name, want in (("std", std), ("skewness", skew), ("kurtosis", kurt)):
        assert (r[name] is None) == (want is None)


def test_mode_tie(spark):
    df = spark.createDataFrame([(v,) for v in "babac"], "x string")
    assert mode_values(df, ["x"]) == {"x": "a"}


def test_hist_constant(spark):
    df = one_col(spark, [5.0, 5.0])
    rows = binned_counts(df, {"x": (5.0, 5.0, 3)}).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [0, 2, 0]
    assert rows[0]["lower"] == 4.5 and rows[-1]["upper"] == 5.5


def test_hist_edges(spark):
    df = one_col(spark, [0.0, 1.9, 2.0, 9.9, 10.0])
    rows = binned_counts(df, {"x": (0.0, 10.0, 5)}).orderBy("bin").collect()
    assert [r["count"] for r in rows] == [2, 1, 0, 0, 2]


def test_infinite(spark):
    df = one_col(spark, [1.0, float("inf"), 2.0, None])
    infs, _ = final_counts(df)
    assert infs == {"x": 1}
    out, _ = infinities_to_null(df, infs)
    assert sorted([r["x"] for r in out.collect()], key=lambda v: (v is None, v)) == [1.0, 2.0, None, None]


def test_whitespace(spark):
    df = spark.createDataFrame([("\ta\n",), ("nan",), ("  ",), (" b c ",)], "x string")
    out, log = trim_strings(df)
    assert [r["x"] for r in out.collect()] == ["a", None, None, "b c"]
    assert log[0].affected == 1


def test_date_mixed(spark):
    df = spark.createDataFrame([("2024-01-05",), ("05/01/2024",), ("2024-03-01",)], "d string")
    fmts = sniff_date_columns(df)
    assert fmts["d"][0] == "yyyy-MM-dd" and fmts["d"][1] == pytest.approx(2 / 3)
    out, _ = convert_dates(df, {"d": fmts["d"][0]})
    assert sum(r["d"] is None for r in out.collect()) == 1


def test_header_clash():
    names = standard_names(["A b", "a_b", "!!!"])
    assert len(set(names)) == 3 and all(names)
    assert names[:2] == ["a_b", "a_b_2"]


def test_sales_pipeline(spark):
    df = spark.createDataFrame(SALES, "a long, b string, c double, d long, e string, f string").toDF(*SALES_COLS)
    res = clean(df, checkpoint=False)
    out = res.df
    assert out.columns[:6] == ["order_id", "customer_name", "price", "qty", "region", "order_date"]
    rows = {r["order_id"]: r for r in out.collect()}
    assert len(rows) == 7
    assert rows[3]["price"] == 35.0              # skewed -> median
    assert rows[4]["region"] == "North"          # mode
    assert rows[6]["customer_name"] == "Ann"     # six-way tie -> smallest
    assert rows[5]["order_date"] is None         # not-a-date
    assert res.outliers == {"price": 1}
    assert [rows[i]["price_per_unit"] for i in range(1, 8)] == [5.0, 5.0, 35.0, None, 200.0, 5.0, 5.0]
    assert len(out.columns) == 11
    steps = [r.step for r in res.log_rows]
    assert steps.index("drop_duplicates") < steps.index("impute") < steps.index("convert_dates")


def test_sales_correlations(spark):
    df = spark.createDataFrame([(1, 10.0, 2), (2, 20.0, 4), (3, 35.0, 1), (4, 30.0, 0), (5, 1000.0, 5),
                                (6, 40.0, 8), (7, 50.0, 10)], "order_id long, price double, qty long")
    cols, rs, n = correlations(df)
    assert round(rs[(0, 1)], 4) == 0.2368 and round(rs[(0, 2)], 4) == 0.7539 and round(rs[(1, 2)], 4) == 0.1082


def test_quantiles_linear(spark):
    df = one_col(spark, [1.0, 2.0, 3.0, 4.0, 10.0])
    assert quantiles(df, ["x"], [0.25, 0.5, 0.75]) == {"x": [2.0, 3.0, 4.0]}


def test_constant_trend(spark):
    df = spark.createDataFrame([(i, float(i), 5.0) for i in range(12)], "k long, t double, y double") \
        .withColumn("ts", F.timestamp_seconds("k"))
    r = linear_trend(df, "ts", "y", ["k"]).first()
    assert r["r2"] == 0.0 and r["n"] == 12


def test_check_not_empty_and_single_column(spark):
    from siftframe.operators.quality import check_not_empty, quality_report
    empty = spark.createDataFrame([], "a long, b string")
    with pytest.raises(ValueError):
        check_not_empty(empty)
    one = spark.createDataFrame([(1,), (1,), (None,)], "a long")
    rows = {r["check"]: r for r in quality_report(one).collect()}
    assert rows["single_column"]["column_name"] == "a"
    assert rows["duplicates"]["value"] == 1
    assert "all_missing" not in rows


def test_quality_report_rejects_empty_input(spark):
    from siftframe.operators.quality import quality_report
    with pytest.raises(ValueError):
        quality_report(spark.createDataFrame([], "a long, b string"))


def test_trim_matches_python_strip(spark):
    from siftframe.operators.tidy import trim_strings
    vals = ["\t abc \n", "　abc ", "\x1cabc\x1f", "a b", " nan ", " None", "   ", None]
    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [r[0] for r in trim_strings(df)[0].collect()]
    want = [None if v is None or v.strip() in ("nan", "None", "") else v.strip() for v in vals]
    assert got == want
