"""Small driver-built frames that stay inside the JVM.

``spark.createDataFrame(list)`` turns rows into a pickled RDD, so every job
that touches it starts Python workers. Report rows (bounded by the column
count) are instead written as one SQL ``VALUES`` literal: a local relation
the optimizer can fold and broadcast, with no Python in the tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _parse(schema: str | T.StructType) -> T.StructType:
    if isinstance(schema, T.StructType):
        return schema
    return T.StructType.fromDDL(schema) if hasattr(T.StructType, "fromDDL") else T._parse_datatype_string(schema)


def sql_literal(v, t: T.DataType) -> str:
    """Exact SQL text for ``v`` typed as ``t``."""
    name = t.simpleString()
    if v is None:
        return f"CAST(NULL AS {name})"
    if isinstance(t, T.BooleanType):
        return "TRUE" if v else "FALSE"
    if isinstance(t, (T.DoubleType, T.FloatType)):
        v = float(v)
        text = "NaN" if math.isnan(v) else repr(v)
        return f"CAST('{text}' AS {name})"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return f"CAST({int(v)} AS {name})"
    if isinstance(t, T.StringType):
        return f"CAST(X'{str(v).encode('utf-8').hex()}' AS STRING)"
    return f"CAST('{v}' AS {name})"


def local_frame(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    st = _parse(schema)
    names = [f.name for f in st.fields]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in st.fields])
    body = ", ".join("(" + ", ".join(sql_literal(v, f.dataType) for v, f in zip(r, st.fields)) + ")"
                     for r in rows)
    cols = ", ".join("`" + n.replace("`", "``") + "`" for n in names)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({cols})")
    return df.select(*[F.col(f"`{n}`").cast(f.dataType).alias(n) for n, f in zip(names, st.fields)])
