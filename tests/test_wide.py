"""Wide tables: correlations from one scan, repeated rows by fingerprint first."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftframe.operators.correlation import correlations
from siftframe.operators.profile import duplicate_count
from siftframe.operators.tidy import drop_duplicates
from siftframe.plans import gram, repeats
from siftframe.plans.gram import co_moment_blocks


def wide_frame(spark, k, rows=400):
    """Columns with shared parts, an offset far from zero, a constant and a gap."""
    made = [(F.sin(F.col("id") * (i + 1)) + (i % 7) * F.cos(F.col("id") / 3) + (1e6 if i % 5 == 0 else 0)).alias(f"c{i}")
            for i in range(k - 2)]
    gap = F.when(F.col("id") != 11, F.col("id") * 0.5).alias("gap")
    return spark.range(0, rows, 1, 5).select(*made, F.lit(0.1).alias("constant"), gap)


def expected(df):
    pdf = df.toPandas().dropna()
    with np.errstate(all="ignore"):
        return len(pdf), np.corrcoef(pdf.to_numpy().T)


def agree(rs, want, k, constant):
    for i in range(k):
        for j in range(i, k):
            if constant in (i, j):
                assert rs[i, j] is None
            else:
                assert rs[i, j] == pytest.approx(want[i, j], abs=1e-9)


def test_three_hundred_columns_are_one_scan(spark):
    df = wide_frame(spark, 300)
    cols, rs, n = correlations(df, df.columns)
    rows, want = expected(df)
    assert n == rows == 399 and len(cols) == 300
    agree(rs, want, 300, 298)
    plan = co_moment_blocks(df.dropna())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Range") == 1


def test_pairs_of_column_groups_and_few_columns_agree(spark, monkeypatch):
    df = wide_frame(spark, 20)
    once = correlations(df, df.columns)
    monkeypatch.setattr(gram, "COLUMNS", 8)
    grouped = correlations(df, df.columns)
    assert once[2] == grouped[2] == 399
    agree(grouped[1], expected(df)[1], 20, 18)
    few = correlations(df.dropna(), df.columns[:5])     # the SQL aggregate, over the same rows
    assert few[2] == 399 and few[1] == {pair: pytest.approx(once[1][pair], abs=1e-9) for pair in few[1]}


def test_correlations_of_no_rows_one_row_and_infinities(spark):
    df = wide_frame(spark, 20)
    for some in (df.limit(0), df.limit(1)):
        _, rs, n = correlations(some, df.columns)
        assert n == some.count() and set(rs.values()) == {None}
    spoilt = df.withColumn("c1", F.when(F.col("c2") == df.first()["c2"], float("inf")).otherwise(F.col("c1")))
    _, rs, _ = correlations(spoilt, df.columns)
    assert all(r is None for (i, j), r in rs.items() if 1 in (i, j))
    assert rs[2, 3] == pytest.approx(expected(df)[1][2, 3], abs=1e-9)


def copied(spark, copies):
    """Rows with NULLs on different sides, -0.0, NaN, texts; a third of all rows one row."""
    base = spark.range(300).select(
        "id", F.when(F.col("id") % 2 == 0, "a").alias("x"), F.when(F.col("id") % 2 == 1, "a").alias("y"),
        F.when(F.col("id") % 3 == 0, float("nan")).otherwise(0.0).alias("_word"), F.lit("t").alias("_repeats"),
        *[F.lit(k).cast("double").alias(f"v{k}") for k in range(6)])
    hot = base.where("id = 4")
    for _ in range(copies):
        base = base.unionAll(hot)
    return base.unionAll(base.where("id in (7, 9)").withColumn("_word", F.when(F.isnan("_word"), float("nan")).otherwise(-0.0)))


@pytest.mark.parametrize("bits", [repeats.BITS, 64])
def test_wide_duplicates(spark, monkeypatch, bits):
    monkeypatch.setattr(repeats, "BITS", bits)
    df = copied(spark, 7)
    assert repeats.is_wide(df)
    want = df.groupBy(*df.columns).count()
    extra = want.agg(F.sum(F.col("count") - 1)).first()[0]
    assert duplicate_count(df).collect() == [(9,)] and extra == 9
    for checkpoint in (False, True):
        out, log = drop_duplicates(df, checkpoint)
        assert out.columns == df.columns and out.count() == 300 == out.distinct().count()
        assert log[0].affected == 9
    unique = df.dropDuplicates()
    assert duplicate_count(unique).collect() == [(0,)] and drop_duplicates(unique)[1] == []
    assert duplicate_count(df.limit(0)).collect() == [(0,)]


def test_equal_fingerprints_are_compared_by_content(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_fingerprint", lambda df: (F.lit(5).cast("long"), F.lit(6).cast("long")))
    df = copied(spark, 2)
    assert duplicate_count(df).collect() == [(4,)]
    assert drop_duplicates(df)[0].count() == 300
