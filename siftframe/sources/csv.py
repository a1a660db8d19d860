"""CSV source (A1): header CSV -> typed table with pandas-style missing tokens.

Every field is read as text, missing tokens become NULL, and each column's
type is chosen from strict patterns counted in a single aggregate (Spark's
own ``inferSchema`` would accept ``t``/``1`` as booleans and turn ISO dates
into dates, which the reference does not do at read time).
"""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftframe.functions.exprs import q
from siftframe.session import materialize
from siftframe.sources.encoding import encoding_audit
from siftframe.sources.records import records

# Text read as missing (pandas' default NA tokens).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# The shapes a column must match completely to be typed.
BOOL_RE = r"(?i)^(true|false)$"
INT_RE = r"^[+-]?\d+$"
FLOAT_RE = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


# Suggested encodings under the names Spark reads them by (the mark is skipped by the reader).
CHARSETS = {"utf-8-sig": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE"}


def _null_tokens(c):
    return F.when(~c.isin(*[F.lit(t) for t in NA_TOKENS]), c)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column -> Spark type name for an all-text frame, from one aggregate.

    boolean: every row is true/false (no gaps); bigint: every value is an
    integer that fits 64 bits and there are no gaps; double: every value is
    a number (integers with gaps included, as in pandas) or the column is
    empty; otherwise string.
    """
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(df.columns):
        x = q(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(x.rlike(BOOL_RE)).alias(f"b{i}"),
                 F.count_if(F.trim(x).rlike(INT_RE) & F.trim(x).try_cast("bigint").isNotNull()).alias(f"i{i}"),
                 F.count_if(F.trim(x).rlike(FLOAT_RE)).alias(f"f{i}")]
    row = df.agg(*aggs).first()
    rows = row["_rows"]
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "double"
        elif row[f"b{i}"] == n == rows:
            out[c] = "boolean"
        elif row[f"i{i}"] == n:
            out[c] = "bigint" if n == rows else "double"
        elif row[f"f{i}"] == n:
            out[c] = "double"
        else:
            out[c] = "string"
    return out


def _cast(c, t: str):
    if t == "boolean":
        return F.lower(c) == F.lit("true")
    return c if t == "string" else F.trim(c).cast(t)


def _checked_cast(name: str, t: T.DataType):
    """The text column ``name`` as type ``t``; a value that is no such value fails the read."""
    if isinstance(t, T.StringType):
        return q(name).alias(name)
    value = F.trim(q(name)).try_cast(t)
    failure = F.raise_error(F.concat(F.lit(f"column {name}: not {t.simpleString()}: "), q(name))).cast(t)
    return F.when(q(name).isNotNull() & value.isNull(), failure).otherwise(value).alias(name)


def read_csv_table(spark: SparkSession, path: str | list[str], encoding: str | None = None,
                   schema: T.StructType | str | None = None, delimiter: str = ",",
                   multi_line: bool | None = None) -> DataFrame:
    """Read header CSV file(s) at ``path`` into a typed DataFrame.

    By default every file is audited first (one scan): it is read in the
    encoding its bytes show (byte-order mark, valid UTF-8, else ISO-8859-1),
    and a file with quoted line breaks is assembled from its splits by
    ``records``; files that need the same are read together and all are
    unioned by position under the first file's header. With ``encoding`` "UTF-8"
    a file that is not valid UTF-8 fails. ``encoding`` may be a name that
    ``encoding_audit`` suggests. ``multi_line`` False takes every line as a row,
    True reads whole files in one task each; with either and an ``encoding``
    other than UTF-8 nothing is audited. UTF-16 files are read whole.

    With an explicit ``schema`` missing tokens become NULL and each value is cast;
    one that does not fit fails the read. Otherwise types are inferred by
    ``infer_types``. Duplicate header names get Spark's numbered suffixes.
    Inside quotes a doubled quote is one quote and a backslash is itself.
    Missing trailing fields read as NULL; a row with more fields than the
    header fails the read.
    """
    text = _text_table(spark, path, encoding, schema, delimiter, multi_line)
    if schema is None:
        return typed_from_text(text)
    wanted = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    text = text.select(*[_null_tokens(q(c)).alias(c) for c in text.columns])
    return text.select(*[_checked_cast(f.name, f.dataType) for f in wanted.fields])


def _text_table(spark: SparkSession, path, encoding, schema, delimiter: str, multi_line: bool | None) -> DataFrame:
    """All fields as text, under the names of ``schema`` or of the first file's header."""
    groups = _read_groups(spark, path, encoding, delimiter, multi_line)
    names = None
    if schema is not None:
        names = (spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema).names
    tables = []
    for (charset, how), paths in groups:
        if how == "assembled":
            made = materialize(records(spark, paths, charset, delimiter))  # read for the header, the types and the rows
            if names is None:
                names = _header_names(made, delimiter)
            tables.append(_parsed(made.where("not head"), names, delimiter))
            continue
        reader = (spark.read.option("header", True).option("encoding", charset).option("sep", delimiter)
                  .option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", how == "whole"))
        if names is None:
            names = reader.option("inferSchema", False).csv(paths).columns
        tables.append(_without_extra_fields(reader, paths, _text_schema(names), delimiter))
    return reduce(DataFrame.union, tables)


def _text_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _read_groups(spark: SparkSession, path, encoding: str | None, delimiter: str, multi_line: bool | None):
    """((charset, how), paths) for the files that are read alike, in the order of their first file.

    how is "lines", "assembled" or "whole". The driver sees one row a file, like
    Spark's own file listing.
    """
    fixed = None if encoding is None else CHARSETS.get(encoding.lower(), encoding)
    paths = path if isinstance(path, list) else [path]
    if fixed is not None and fixed.upper() not in ("UTF-8", "UTF8") and multi_line is not None:
        return [((fixed, "whole" if multi_line else "lines"), paths)]
    groups: dict[tuple[str, str], list[str]] = {}
    for f in encoding_audit(spark, paths, delimiter).orderBy("path").collect():
        if fixed is not None and fixed.upper() in ("UTF-8", "UTF8") and not f["valid_utf8"]:
            raise ValueError(f"{f['path']} is not valid UTF-8")
        charset = fixed or CHARSETS.get(f["suggested"], f["suggested"])
        if charset.upper().startswith("UTF-16") or multi_line:
            how = "whole"
        else:
            how = "assembled" if f["open_quotes"] and multi_line is None else "lines"
        groups.setdefault((charset, how), []).append(f["path"])
    return list(groups.items())


def _header_names(made: DataFrame, delimiter: str) -> list[str]:
    """Column names of the first file's head, repeated and empty ones numbered as Spark's reader does."""
    head = made.where("head").orderBy("path").first()["record"].removeprefix("\ufeff")
    fields = next(csv.reader([head], delimiter=delimiter)) if "\n" not in head else next(csv.reader(head.splitlines(True), delimiter=delimiter))
    low = [f.lower() for f in fields]
    return [f"_c{i}" if not f else f"{f}{i}" if low.count(f.lower()) > 1 else f for i, f in enumerate(fields)]


def _parsed(made: DataFrame, names: list[str], delimiter: str) -> DataFrame:
    """The fields of assembled records; one with more fields than ``names`` fails the read."""
    sep = re.escape(delimiter)
    bare = F.regexp_replace("record", f'(^|{sep})"(?:[^"]|"")*+"', "$1")
    extra = F.size(F.split(bare, sep, -1)) > len(names)
    failure = F.raise_error(F.concat(F.lit(f"row with more than {len(names)} fields: "), F.col("record"))).cast("boolean")
    made = made.where(F.when(extra, failure).otherwise(F.lit(True)))
    fields = ", ".join(f"f{i} string" for i in range(len(names)))
    row = F.from_csv("record", fields, {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"})
    return made.select(row.alias("r")).select(*[F.col(f"r.f{i}").alias(n) for i, n in enumerate(names)])


def _without_extra_fields(reader, path: list[str], schema: T.StructType, delimiter: str) -> DataFrame:
    """The rows under ``schema``, with an error for a row that has more fields than it.

    The reader only says that a row does not fit, so the separators outside
    quotes of those rows are counted. Column pruning is off because it would
    skip the reader's own comparison of field counts.
    """
    if not schema.fields:
        return reader.schema(schema).csv(path)
    bad = "_misfit"
    while bad in schema.names:
        bad += "_"
    df = (reader.option("columnNameOfCorruptRecord", bad).option("columnPruning", False)
          .schema(T.StructType([*schema.fields, T.StructField(bad, T.StringType())])).csv(path))
    sep = re.escape(delimiter)
    bare = F.regexp_replace(bad, f'(^|{sep})"(?:[^"]|"")*+"', "$1")
    extra = F.size(F.split(bare, sep, -1)) > len(schema)
    # the first column is named because a query of the misfit column alone is not allowed
    failure = F.raise_error(F.concat_ws(" ", F.lit(f"row with more than {len(schema)} fields, first and whole:"),
                                        q(schema.names[0]).cast("string"), F.col(bad))).cast("boolean")
    return df.where(F.when(F.col(bad).isNotNull() & extra, failure).otherwise(F.lit(True))).drop(bad)


def typed_from_text(text: DataFrame) -> DataFrame:
    """Missing tokens -> NULL, then each text column cast to its inferred type."""
    strings = {f.name for f in text.schema.fields if isinstance(f.dataType, T.StringType)}
    text = text.select(*[_null_tokens(q(c)).alias(c) if c in strings else q(c) for c in text.columns])
    types = infer_types(text.select(*[q(c) for c in text.columns if c in strings]))
    return text.select(*[_cast(q(c), types[c]).alias(c) if c in strings else q(c) for c in text.columns])
