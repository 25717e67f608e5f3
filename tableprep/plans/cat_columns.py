"""Queries for projection / schema operators: P1-P3, P5-P7, P11, P12."""

from __future__ import annotations

from ..operators import columns as C
from .catalogue import query, table


@query("drop_cols", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def drop_cols(spark, sf):
    return C.DropColumns(columns=["c_nationkey", "c_acctbal"])(table(spark, sf, "customer"))


@query("dup_cols", "SELECT *, c_name AS name_copy, c_acctbal AS bal FROM customer")
def dup_cols(spark, sf):
    return C.DuplicateColumns(table={"c_name": "name_copy", "c_acctbal": "bal"})(table(spark, sf, "customer"))


@query("rename_swap", """
SELECT c_custkey, c_name AS c_mktsegment, c_nationkey, c_acctbal, c_mktsegment AS c_name FROM customer""")
def rename_swap(spark, sf):
    return C.RenameColumns(names={"c_name": "c_mktsegment", "c_mktsegment": "c_name"})(
        table(spark, sf, "customer"))


@query("select_regex", "SELECT c_custkey, c_nationkey FROM customer")
def select_regex(spark, sf):
    return C.select_by(table(spark, sf, "customer"), regex="KEY$")


@query("select_type", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_type(spark, sf):
    return C.select_by(table(spark, sf, "customer"), types=["numeric"])


@query("set_reset_index", """
SELECT s_suppkey AS s_suppkey_index, s_name, s_nationkey, s_acctbal, s_nationkey AS s_suppkey FROM supplier""")
def set_reset_index(spark, sf):
    t = C.SetIndex(columns=["s_suppkey"])(C.Table(table(spark, sf, "supplier")))
    t = C.DuplicateColumns(table={"s_nationkey": "s_suppkey"})(t)  # same name as the index level
    return C.ResetIndex()(t).df


@query("table_info", """
SELECT count(*) AS rows, 4 AS columns, 1 AS index_levels, 'c_custkey' AS index_names FROM customer""")
def table_info(spark, sf):
    t = C.SetIndex(columns=["c_custkey"])(C.Table(table(spark, sf, "customer")))
    return C.table_info(t)


@query("ints_to_floats", """
SELECT CAST(s_suppkey AS DOUBLE) AS s_suppkey, s_name, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal
FROM supplier""")
def ints_to_floats(spark, sf):
    return C.IntsToFloats()(table(spark, sf, "supplier"))


@query("sort_by_priority", """
SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders""")
def sort_by_priority(spark, sf):
    from ..operators.convert import ToCategorical
    from ..operators.order import SortRows
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    o = ToCategorical(attributes={"o_orderpriority": {"cat": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH",
                                                                "1-URGENT"], "ordered": True}})(o)
    return SortRows(by=["o_orderpriority", "o_orderdate"])(o)


@query("append_tables", """
SELECT o_orderkey AS k, o_totalprice AS amount, NULL::VARCHAR AS note FROM orders
UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer""")
def append_tables_q(spark, sf):
    from pyspark.sql import functions as F
    from ..operators.order import append_tables
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("amount"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("amount"),
                                            F.col("c_mktsegment").alias("note"))
    return append_tables(o, c)


# order made visible: rows with their positions
@query("sort_positions", """
SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 0
  WHEN '4-NOT SPECIFIED' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 4 END, o_orderdate DESC, o_orderkey) - 1 AS position
FROM orders""")
def sort_positions(spark, sf):
    from ..operators.convert import ToCategorical
    from ..operators.order import with_positions
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    o = ToCategorical(attributes={"o_orderpriority": {"cat": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"], "ordered": True}})(o)
    return with_positions(o, ["o_orderpriority", "o_orderdate", "o_orderkey"], [True, False, True])
