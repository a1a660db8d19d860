"""Sources, sinks, streaming and the full report, on files in a fresh temp folder."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from siftframe.plans.report import full_report
from siftframe.sources import cleaned_name, encoding_audit, read_csv_table, read_parquet_table, write_table
from siftframe.streaming import clean_stream
from siftframe.suite.common import table

CSV = """Order ID, Customer Name ,Price,Qty,Region,Order Date,Flag,Empty
1, Ann ,10.0,2,North,2024-01-05,true,
2,Bob,20.0,4,South,2024-01-06,false,NA
2,Bob,20.0,4,South,2024-01-06,false,
3,Cy,,1,North,2024-01-07,TRUE,
4,Di,30.0,0,NA,2024-01-08,false,
5, Ed,1000.0,5,North,not-a-date,true,
6,n/a,40.0,8,South,2024-01-10,false,
7,Flo,50.0,10,East,2024-01-11,False,
"""


def _write(folder, name, data: bytes):
    p = os.path.join(folder, name)
    with open(p, "wb") as f:
        f.write(data)
    return p


def test_read_csv_types_and_tokens(spark):
    d = tempfile.mkdtemp(prefix="sift-csv-")
    p = _write(d, "sales.csv", CSV.encode())
    df = read_csv_table(spark, p)
    types = dict(df.dtypes)
    assert types["Order ID"] == "bigint" and types["Price"] == "double" and types["Qty"] == "bigint"
    assert types["Region"] == "string" and types["Order Date"] == "string"
    assert types["Flag"] == "boolean" and types["Empty"] == "double"
    rows = df.collect()
    assert rows[3]["Price"] is None and rows[4]["Region"] is None and rows[6][" Customer Name "] is None
    assert rows[0][" Customer Name "] == " Ann "  # trimming is a cleaning step, not a read step


def test_read_csv_field_counts(spark):
    """Rows with too few fields are padded; one field too many fails, also under a schema and for a bare count."""
    d = tempfile.mkdtemp(prefix="sift-csv-")
    fits = _write(d, "fits.csv", b'a,b,c\n1,"x,y,z",2\n2,q\n3,"he said ""a,b""",4\n')
    rows = read_csv_table(spark, fits).orderBy("a").collect()
    assert [tuple(r) for r in rows] == [(1, "x,y,z", 2.0), (2, "q", None), (3, 'he said "a,b"', 4.0)]
    for name, row in (("more.csv", b"3,4,5\n"), ("blank.csv", b"3,4,\n")):
        p = _write(d, name, b"a,b\n1,2\n" + row)
        for schema in (None, "a int, b int"):
            with pytest.raises(Exception, match="more than 2 fields"):
                read_csv_table(spark, p, schema=schema).count()
    semi = _write(d, "semi.csv", b"a;b\n1;2,5\n")
    assert read_csv_table(spark, semi, delimiter=";").collect()[0]["b"] == "2,5"


def test_encoding_audit(spark):
    d = tempfile.mkdtemp(prefix="sift-enc-")
    _write(d, "a.csv", "x,y\n1,é\n".encode("utf-8"))
    _write(d, "b.csv", "x,y\n1,é\n".encode("latin-1"))
    _write(d, "c.csv", b"\xef\xbb\xbfx,y\n1,2\n")
    got = {os.path.basename(r["path"]): r["suggested"] for r in encoding_audit(spark, d).collect()}
    assert got == {"a.csv": "UTF-8", "b.csv": "ISO-8859-1", "c.csv": "utf-8-sig"}


def test_encoding_audit_large_and_marked_files(spark):
    d = tempfile.mkdtemp(prefix="sift-enc2-")
    _write(d, "u16.csv", "x,y\n1,é\n".encode("utf-16"))
    _write(d, "sig_crlf.csv", b"\xef\xbb\xbfx,y\r\n1,2")      # mark, CRLF, no final newline
    _write(d, "crlf.csv", "x,y\r\n1,é\r\n".encode("utf-8"))
    # a file of many splits whose only non-UTF-8 byte is far past its head
    _write(d, "big.csv", ("x,y\n" + "1,é\n" * 400_000).encode("utf-8") + "2,é\n".encode("latin-1"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        got = {os.path.basename(r["path"]): (r["bom"], r["suggested"]) for r in encoding_audit(spark, d).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {"u16.csv": ("utf-16-le", "utf-16-le"), "sig_crlf.csv": ("utf-8-sig", "utf-8-sig"),
                   "crlf.csv": (None, "UTF-8"), "big.csv": (None, "ISO-8859-1")}


def test_write_round_trip(spark, sf_small):
    d = tempfile.mkdtemp(prefix="sift-out-")
    df = table(spark, sf_small, "orders")
    write_table(df, os.path.join(d, "o.parquet"))
    back = read_parquet_table(spark, os.path.join(d, "o.parquet"))
    assert back.count() == df.count() and back.dtypes == df.dtypes
    out = os.path.join(d, cleaned_name("sales.csv"))
    write_table(df.select("o_orderkey", "o_orderstatus"), out, format="csv")
    again = read_csv_table(spark, out)
    assert again.count() == df.count() and dict(again.dtypes)["o_orderkey"] == "bigint"


def test_clean_stream(spark):
    d = tempfile.mkdtemp(prefix="sift-stream-")
    src = os.path.join(d, "in")
    os.makedirs(src)
    _write(src, "sales.csv", CSV.encode())
    schema = read_csv_table(spark, src).schema
    text_schema = ", ".join(f"`{f.name}` string" for f in schema.fields)
    stream = spark.readStream.schema(text_schema).option("header", True).csv(src)
    q = clean_stream(stream, os.path.join(d, "out"), os.path.join(d, "ckpt"))
    q.awaitTermination(120)
    out = spark.read.parquet(os.path.join(d, "out", "batch_id=0"))
    assert out.count() == 7
    assert dict(out.dtypes)["price"] == "double" and "is_outlier_price" in out.columns


def test_stream_batches_share_their_types(spark):
    d = tempfile.mkdtemp(prefix="sift-stream-")
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    os.makedirs(src)
    for name, base, extra in (("a.csv", 0, "0.5"), ("b.csv", 100_000, "2")):
        _write(src, name, ("id,v\n" + "".join(f"{base + k},{extra}\n" for k in range(5))).encode())
        q = clean_stream(spark.readStream.schema("id string, v string").option("header", True).csv(src), out,
                         os.path.join(d, "ckpt"))
        q.awaitTermination(120)
    rows = spark.read.parquet(out)
    assert dict(rows.dtypes)["id"] == "bigint" and dict(rows.dtypes)["v"] == "double"
    assert sorted(r.id for r in rows.collect()) == [*range(5), *range(100_000, 100_005)]
    assert {r.v for r in rows.collect()} == {0.5, 2.0}


def test_full_report(spark, sf_small):
    rep = full_report(table(spark, sf_small, "events"), tiebreak=["event_id"], checkpoint=False)
    assert {"descriptive_stats", "correlation", "distributions", "frequency_tables", "charts",
            "insights", "summary", "line_series"} <= set(rep)
    assert rep["summary"].first()["total_rows"] == 1000
    assert rep["line_series"].count() > 0
    assert rep["insights"].where(F.col("kind") == "trend").count() == 2


def test_full_report_computes_each_statistic_once(spark, sf_small, monkeypatch):
    """One wide aggregate, one quantile plan, one grouped count, one correlation, one pass over the bins."""
    import importlib
    calls = []
    for module, name in (("plans.facts", "wide_agg"), ("operators.histogram", "wide_agg"), ("operators.stats", "wide_agg"),
                         ("plans.facts", "quantiles"), ("operators.histogram", "quantiles"), ("operators.stats", "quantiles"),
                         ("operators.frequency", "value_counts"), ("plans.facts", "correlations"),
                         ("operators.narrative", "correlations"), ("plans.facts", "binned_counts"), ("operators.histogram", "binned_counts")):
        at = importlib.import_module(f"siftframe.{module}")
        real = getattr(at, name)
        monkeypatch.setattr(at, name, lambda *a, real=real, name=name, **k: (calls.append(name), real(*a, **k))[1])
    full_report(table(spark, sf_small, "events"), tiebreak=["event_id"], checkpoint=False)
    assert sorted(calls) == ["binned_counts", "correlations", "quantiles", "value_counts", "wide_agg"]


def _many_splits(spark, size=300):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


def test_quoted_line_breaks_in_splits(spark):
    """Records over several lines, some longer than a split, equal what one reader of the whole file gives."""
    import csv
    import io
    import random
    rng = random.Random(2)
    d = tempfile.mkdtemp(prefix="sift-breaks-")
    pieces = ["a", "é", '"', "\n", ",", "\r\n", ' "x" ', "long " * 90, "", "\n\n", '""', "5' pipe"]
    expected = []
    for name in ("a.csv", "b.csv"):
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["id", "te\nxt", "more"])
        for k in range(150):
            row = [str(len(expected)), "t" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))), rng.choice(["u", 'v"w', "x\ny"])]
            expected.append(tuple(row))
            w.writerow(row)
        _write(d, name, out.getvalue().encode())
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        _many_splits(spark)
        df = read_csv_table(spark, d)
        assert df.columns == ["id", "te\nxt", "more"] and dict(df.dtypes)["id"] == "bigint"
        rows = sorted(df.collect())
        assert [(str(r[0]), r[1], r[2]) for r in rows] == expected
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    _write(d, "c.csv", b'id,text,more\n1,"never closed,\n2,x,y\n')
    with pytest.raises(Exception, match="not closed"):
        read_csv_table(spark, d).collect()


def test_quote_states_of_lines(spark):
    from siftframe.sources.records import state_after
    lines = {'a,b': (0, 1), 'a,"b': (1, 0), 'a"b,c': (0, 0), '"a""b': (1, 1), 'x",y': (0, 0), '"a",b': (0, 1), '""': (0, 1),
             '"a,""b"",c': (1, 1), '","': (0, 1), 'z","k': (1, 1)}
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    # the states by a plain automaton
    def walk(line, state):
        k, field = 0, state == 0
        while k < len(line):
            c = line[k]
            if state == 1:
                if line[k:k + 2] == '""':
                    k += 1
                elif c == '"':
                    state, field = 0, False
            elif c == '"' and field:
                state = 1
            else:
                field = c == ","
            k += 1
        return state
    for r in df.select("line", state_after(F.col("line"), ",", 0).alias("zero"), state_after(F.col("line"), ",", 1).alias("one")).collect():
        assert (r.zero, r.one) == (walk(r.line, 0), walk(r.line, 1)), r.line


def test_encodings_of_a_folder(spark):
    d = tempfile.mkdtemp(prefix="sift-encodings-")
    for k, (name, codec) in enumerate([("u8.csv", "utf-8"), ("l1.csv", "latin-1"), ("u16.csv", "utf-16"), ("sig é.csv", "utf-8-sig")]):
        _write(d, name, f"id,word\n{k},café ü\n{k + 10},\"two\nlines é\"\n".encode(codec))
    rows = sorted(tuple(r) for r in read_csv_table(spark, d).collect())
    assert rows == [(k, "café ü") for k in range(4)] + [(k + 10, "two\nlines é") for k in range(4)]
    with pytest.raises(ValueError, match="l1.csv is not valid UTF-8"):
        read_csv_table(spark, os.path.join(d, "l1.csv"), encoding="UTF-8")


def test_a_value_that_does_not_fit_its_type_fails(spark):
    d = tempfile.mkdtemp(prefix="sift-misfit-")
    p = _write(d, "n.csv", b"n,t\n1,2024-01-05 10:11:12.123456\nNA,\n 3 ,2024-01-06\n")
    rows = read_csv_table(spark, p, schema="n long, t timestamp_ntz").collect()
    assert [r.n for r in rows] == [1, None, 3] and rows[0].t.microsecond == 123456
    _write(d, "n.csv", b"n,t\n1,2024-01-05\nx,2024-01-06\n")
    with pytest.raises(Exception, match="column n: not bigint: x"):
        read_csv_table(spark, p, schema="n long, t timestamp_ntz").collect()


def test_csv_keeps_microseconds(spark):
    d = tempfile.mkdtemp(prefix="sift-micro-")
    out = os.path.join(d, "t")
    write_table(spark.sql("select 1 as k, timestamp'2024-01-05 10:11:12.123456' as t, timestamp_ntz'2024-01-05 10:11:12.000001' as n, 'a \"b\"\nc' as s"),
                out, format="csv")
    row = read_csv_table(spark, out, schema="k int, t timestamp, n timestamp_ntz, s string").collect()[0]
    assert (row.t.microsecond, row.n.microsecond, row.s) == (123456, 1, 'a "b"\nc')
