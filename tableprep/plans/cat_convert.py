"""Queries for type conversion (T1-T5) and value replacement."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.convert import ToCategorical, ToNumeric, ToString, ToTimestamp
from ..operators.replace import ReplaceValues
from ..operators.encode import CategoryCodes
from .catalogue import query, table
from .cat_missing import ORDERS_NULLS_SQL, orders_nulls

# text column mixing numbers ("17.30") and words
PART_TXT_SQL = ("SELECT p_partkey, CASE WHEN p_size > 25 THEN substr(p_brand, 7) || '.' || CAST(p_size AS VARCHAR) "
                "ELSE p_name END AS txt FROM part")


def part_txt(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.when(F.col("p_size") > 25, F.concat(
        F.substring("p_brand", 7, 100), F.lit("."), F.col("p_size").cast("string"))).otherwise(
        F.col("p_name")).alias("txt"))


@query("to_numeric_coerce", f"""
WITH t AS ({PART_TXT_SQL})
SELECT p_partkey, CASE WHEN regexp_matches(trim(txt), '^[-+]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][-+]?[0-9]+)?$') THEN TRY_CAST(trim(txt) AS DOUBLE)
       WHEN lower(trim(txt)) IN ('inf', '+inf', 'infinity') THEN 'inf'::DOUBLE
       WHEN lower(trim(txt)) IN ('-inf', '-infinity') THEN '-inf'::DOUBLE END AS txt FROM t""")
def to_numeric_coerce(spark, sf):
    return ToNumeric(attributes=["txt"], errors="coerce")(part_txt(spark, sf))


@query("to_categorical_list", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority END
       AS o_orderpriority FROM orders""")
def to_categorical_list(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return ToCategorical(attributes={"o_orderpriority": {"cat": ["1-URGENT", "2-HIGH", "3-MEDIUM"],
                                                         "ordered": True}})(o)


@query("to_categorical_all", """
SELECT p_partkey, CAST(CAST(p_size AS DOUBLE) AS VARCHAR) AS p_size,
       CAST(p_retailprice AS VARCHAR) AS p_retailprice FROM part""")
def to_categorical_all(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return ToCategorical(attributes={"p_size": {}, "p_retailprice": {}})(p)


DATE_TXT_SQL = ("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'not a date' "
                "ELSE strftime(o_orderdate, '%d%m%Y') END AS txt FROM orders")


@query("to_datetime_coerce", f"""
WITH t AS ({DATE_TXT_SQL}) SELECT o_orderkey, try_strptime(txt, '%d%m%Y') AS txt FROM t""")
def to_datetime_coerce(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "ddMMyyyy")).alias("txt"))
    return ToTimestamp(attributes={"txt": {"format": "%d%m%Y"}}, errors="coerce")(o)


@query("to_datetime_infer", """
SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) AS txt FROM orders""")
def to_datetime_infer(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("txt"))
    return ToTimestamp(attributes={"txt": {}}, errors="raise")(o)


@query("to_string_double", """
SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price, CAST(o_totalprice * 1e12 AS VARCHAR) AS big,
       CAST(o_totalprice / 1e9 AS VARCHAR) AS small, CAST(o_orderdate AS VARCHAR) AS odate,
       CAST(CAST(o_custkey AS DOUBLE) AS VARCHAR) AS cust FROM orders""")
def to_string_double(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("price"), (F.col("o_totalprice") * 1e12).alias("big"),
        (F.col("o_totalprice") / 1e9).alias("small"), F.col("o_orderdate").alias("odate"),
        F.col("o_custkey").alias("cust"))
    return ToString(attributes=["price", "big", "small", "odate", "cust"])(o)


@query("replace_seq", """
WITH a AS (SELECT c_custkey,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'INDUSTRY' ELSE c_mktsegment END AS seg,
  CASE WHEN CAST(c_nationkey AS DOUBLE) IN (1, 2, 3) THEN -1.0 ELSE CAST(c_nationkey AS DOUBLE) END AS nk
  FROM customer)
SELECT c_custkey, CASE WHEN seg IN ('INDUSTRY', 'HOUSEHOLD') THEN 'OTHER' ELSE seg END AS c_mktsegment,
       CASE WHEN nk IN (-1, 4) THEN -2.0 ELSE nk END AS c_nationkey FROM a""")
def replace_seq(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return ReplaceValues(table={
        "c_mktsegment": {"values": [["BUILDING", "MACHINERY"], ["INDUSTRY", "HOUSEHOLD"]],
                         "replace": ["INDUSTRY", "OTHER"]},
        "c_nationkey": {"values": [[1, 2, 3], [-1, 4, "x"]], "replace": [-1, -2]}})(c)


@query("replace_inverted", """
SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type ELSE 'OTHER' END AS p_type,
       CASE WHEN p_size IN (1, 2, 3) THEN CAST(p_size AS DOUBLE) ELSE 0.0 END AS p_size FROM part""")
def replace_inverted(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type", "p_size")
    return ReplaceValues(table={"p_type": {"values": [["ECONOMY", "SMALL"]], "replace": ["OTHER"]},
                                "p_size": {"values": [[1, 2, 3]], "replace": [0]}}, inverted=True)(p)


@query("replace_null", f"""
WITH t AS ({ORDERS_NULLS_SQL})
SELECT o_orderkey, CASE WHEN price IS NULL THEN -1.0 ELSE price END AS price,
       CASE WHEN prio IS NULL OR prio = '1-URGENT' THEN 'none' WHEN prio = '2-HIGH' THEN NULL ELSE prio END AS prio,
       odate, status FROM t""")
def replace_null(spark, sf):
    return ReplaceValues(table={
        "price": {"values": [["nan"]], "replace": [-1]},
        "prio": {"values": [[None, "1-URGENT"], ["2-HIGH"]], "replace": ["none", None]}})(orders_nulls(spark, sf))


@query("to_numeric_raise", """
SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS txt FROM orders""")
def to_numeric_raise(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit(" "), F.col("o_totalprice").cast("string")).alias("txt"))
    return ToNumeric(attributes=["txt"], errors="raise")(o)


# more distinct values than a column's metadata lists: codes come from a table of categories
@query("to_categorical_wide", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS k FROM lineitem),
c AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT k FROM t))
SELECT l_orderkey, l_linenumber, CAST(code AS INTEGER) AS k FROM t JOIN c USING (k)""")
def to_categorical_wide(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("k"))
    return CategoryCodes(attributes=["k"])(ToCategorical(attributes={"k": {"cat": None}})(t))
