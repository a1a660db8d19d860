"""Table loading and the shared 'dirty' derivations used by both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftframe.sources.parquet import read_parquet_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def sql_list(names: list[str]) -> str:
    return ", ".join(names)


def union_all(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


# Shared dirt, written once as SQL select lists valid in Spark and DuckDB.
# Every row of the source table is kept; these only blank or alter values.
DIRTY_LINEITEM = [
    "l_orderkey",
    "l_linenumber",
    "CASE WHEN (l_orderkey + l_linenumber) % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
    "l_extendedprice",
    "CASE WHEN l_orderkey % 5 = 1 THEN NULL ELSE l_returnflag END AS l_returnflag",
    "CASE WHEN l_linenumber = 3 THEN NULL ELSE l_shipdate END AS l_shipdate",
]

# Key-free projection of lineitem: has many natural full-row duplicates.
LINEITEM_NO_KEYS = ["l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"]

# All lineitem columns with a second row for each: every tenth order's rows are copies, the others differ in price.
COPIED_PRICE = "CASE WHEN l_orderkey % 10 = 0 THEN l_extendedprice ELSE l_extendedprice + 0.5 END"
SQL_COPIED_LINEITEM = f"(SELECT * FROM lineitem UNION ALL SELECT * REPLACE ({COPIED_PRICE} AS l_extendedprice) FROM lineitem)"


def copied_lineitem(spark, sf_dir: str):
    d = table(spark, sf_dir, "lineitem")
    return d.unionAll(d.withColumn("l_extendedprice", F.expr(COPIED_PRICE)))


def dirty(spark, sf_dir: str, name: str, select: list[str]):
    return table(spark, sf_dir, name).selectExpr(*select)


def sql_from(name: str, select: list[str]) -> str:
    return f"(SELECT {', '.join(select)} FROM {name})"


# DuckDB type name -> Spark simpleString / kind, for the schema oracles.
SQL_TYPE_NAMES = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int'
  WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
  WHEN 'FLOAT' THEN 'float' WHEN 'SMALLINT' THEN 'smallint' WHEN 'TINYINT' THEN 'tinyint'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DATE' THEN 'date' ELSE lower(data_type) END"""
SQL_KINDS = """CASE WHEN data_type IN ('BIGINT','INTEGER','DOUBLE','FLOAT','SMALLINT','TINYINT','BOOLEAN')
  THEN 'numeric' WHEN data_type IN ('TIMESTAMP','DATE','TIMESTAMP WITH TIME ZONE') THEN 'datetime'
  WHEN data_type LIKE '%[]' OR data_type LIKE 'STRUCT%' OR data_type LIKE 'MAP%' THEN 'other'
  ELSE 'categorical' END"""


# Dirty orders for the whole pipeline: messy names, padded text, gaps, dates
# as text with failures, an empty column, and every row twice.
DIRTY_ORDERS = [
    "o_orderkey",
    "o_custkey",
    "concat(' ', o_orderstatus, chr(9)) AS o_orderstatus",
    "CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 97 = 0 THEN o_totalprice * 20"
    " ELSE o_totalprice END AS o_totalprice",
    "CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS o_orderdate",
    "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority",
    "CAST(NULL AS DOUBLE) AS extra_empty",
]
DIRTY_ORDER_NAMES = ["O OrderKey", "o-CustKey", " O_OrderStatus ", "o totalprice", "O OrderDate!",
                     "o__orderpriority", "Extra Empty"]


def dirty_orders(spark, sf_dir: str):
    d = dirty(spark, sf_dir, "orders", DIRTY_ORDERS)
    return d.unionAll(d).toDF(*DIRTY_ORDER_NAMES)


SQL_DIRTY_ORDERS = f"(SELECT * FROM {sql_from('orders', DIRTY_ORDERS)} UNION ALL SELECT * FROM {sql_from('orders', DIRTY_ORDERS)})"
