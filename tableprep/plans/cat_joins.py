"""Queries for joins J1-J9 (null-safe equi-joins on columns or index levels)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.columns import SetIndex
from ..operators.join import Join
from ..table import Table
from .catalogue import query, table

ORD = "SELECT o_orderkey, o_custkey, o_totalprice FROM orders"
# all rows are read: a key turned negative gives a row without partner
CUST = ("SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN -c_custkey ELSE c_custkey END AS c_custkey, "
        "c_name, c_acctbal FROM customer")


def _lost(cond, key, name=None):
    """The key, negative where ``cond`` holds: those rows find no partner."""
    return F.when(cond, -F.col(key)).otherwise(F.col(key)).alias(name or key)


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


def _cust(spark, sf):
    return table(spark, sf, "customer").select(_lost(F.col("c_mktsegment") == "AUTOMOBILE", "c_custkey"), "c_name", "c_acctbal")


@query("join_left_cols", f"""
SELECT o.*, c.* FROM ({ORD}) o LEFT JOIN ({CUST}) c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""")
def join_left_cols(spark, sf):
    return Join(left_on="o_custkey", right_on="c_custkey", how="left")(_orders(spark, sf), _cust(spark, sf))


@query("join_right_cols", f"""
SELECT c.*, o.* FROM ({CUST}) c RIGHT JOIN ({ORD}) o ON c.c_custkey IS NOT DISTINCT FROM o.o_custkey""")
def join_right_cols(spark, sf):
    return Join(left_on="c_custkey", right_on="o_custkey", how="right")(_cust(spark, sf), _orders(spark, sf))


@query("join_inner_cols", f"""
SELECT o.*, c.* FROM ({ORD}) o JOIN ({CUST}) c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey""")
def join_inner_cols(spark, sf):
    return Join(left_on="o_custkey", right_on="c_custkey", how="inner")(_orders(spark, sf), _cust(spark, sf))


# same key name on both sides -> one merged key; a clashing column -> suffixes
OUT_L = ("SELECT CASE WHEN c_acctbal <= 0 THEN -c_custkey ELSE c_custkey END AS custkey, c_name, "
         "c_mktsegment AS note FROM customer")
OUT_R = ("SELECT CASE WHEN o_orderstatus <> 'F' THEN -1000000 - o_custkey ELSE o_custkey END AS custkey, o_orderkey, "
         "o_orderpriority AS note FROM orders")


@query("join_outer_cols", f"""
SELECT coalesce(l.custkey, r.custkey) AS custkey, l.c_name, l.note AS note_l, r.o_orderkey, r.note AS note_r
FROM ({OUT_L}) l FULL OUTER JOIN ({OUT_R}) r ON l.custkey IS NOT DISTINCT FROM r.custkey""")
def join_outer_cols(spark, sf):
    left = table(spark, sf, "customer").select(_lost(F.col("c_acctbal") <= 0, "c_custkey", "custkey"), "c_name",
                                               F.col("c_mktsegment").alias("note"))
    right = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "F", -1000000 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("custkey"),
        "o_orderkey", F.col("o_orderpriority").alias("note"))
    return Join(left_on="custkey", right_on="custkey", how="outer")(left, right)


@query("join_left_index", f"""
SELECT c.c_custkey AS "index", c.c_name, c.c_acctbal, o.o_orderkey, o.o_totalprice
FROM ({CUST}) c LEFT JOIN ({ORD}) o ON c.c_custkey IS NOT DISTINCT FROM o.o_custkey""")
def join_left_index(spark, sf):
    lt = SetIndex(columns=["c_custkey"])(Table(_cust(spark, sf)))
    rt = SetIndex(columns=["o_custkey"])(Table(_orders(spark, sf)))
    return Join(on="index", how="left")(lt, rt).to_df()


@query("join_right_index", f"""
SELECT o.o_custkey AS "index", c.c_name, c.c_acctbal, o.o_orderkey, o.o_totalprice
FROM ({CUST}) c RIGHT JOIN ({ORD}) o ON c.c_custkey IS NOT DISTINCT FROM o.o_custkey""")
def join_right_index(spark, sf):
    lt = SetIndex(columns=["c_custkey"])(Table(_cust(spark, sf)))
    rt = SetIndex(columns=["o_custkey"])(Table(_orders(spark, sf)))
    return Join(on="index", how="right")(lt, rt).to_df()


@query("join_inner_index", f"""
SELECT c.c_custkey AS "index", c.c_name, c.c_acctbal, o.o_orderkey, o.o_totalprice
FROM ({CUST}) c JOIN ({ORD}) o ON c.c_custkey IS NOT DISTINCT FROM o.o_custkey""")
def join_inner_index(spark, sf):
    lt = SetIndex(columns=["c_custkey"])(Table(_cust(spark, sf)))
    rt = SetIndex(columns=["o_custkey"])(Table(_orders(spark, sf)))
    return Join(on="index", how="inner")(lt, rt).to_df()


@query("join_outer_index", """
WITH l AS (SELECT CASE WHEN c_acctbal <= 0 THEN -c_custkey ELSE c_custkey END AS custkey, c_name, c_acctbal AS bal FROM customer),
r AS (SELECT CASE WHEN o_orderstatus <> 'O' THEN -1000000 - o_custkey ELSE o_custkey END AS custkey, o_orderkey,
             o_totalprice AS bal FROM orders)
SELECT coalesce(l.custkey, r.custkey) AS custkey, l.c_name, l.bal AS bal_ll, r.o_orderkey, r.bal AS bal_rr
FROM l FULL OUTER JOIN r ON l.custkey IS NOT DISTINCT FROM r.custkey""")
def join_outer_index(spark, sf):
    left = table(spark, sf, "customer").select(_lost(F.col("c_acctbal") <= 0, "c_custkey", "custkey"), "c_name",
                                               F.col("c_acctbal").alias("bal"))
    right = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "O", -1000000 - F.col("o_custkey")).otherwise(F.col("o_custkey")).alias("custkey"),
        "o_orderkey", F.col("o_totalprice").alias("bal"))
    lt = SetIndex(columns=["custkey"])(Table(left))
    rt = SetIndex(columns=["custkey"])(Table(right))
    return Join(on="index", how="outer", suffixes=("_ll", "_rr"))(lt, rt).to_df()


@query("join_multi_index", """
WITH l AS (SELECT CASE WHEN c_acctbal <= 0 THEN -1 - c_nationkey ELSE c_nationkey END AS nationkey, c_custkey, c_name FROM customer),
r AS (SELECT CASE WHEN n_regionkey = 1 THEN 1000 + n_nationkey ELSE n_nationkey END AS nationkey, n_regionkey, n_name FROM nation)
SELECT coalesce(l.nationkey, r.nationkey) AS nationkey, l.c_custkey, r.n_regionkey, l.c_name, r.n_name
FROM l FULL OUTER JOIN r ON l.nationkey IS NOT DISTINCT FROM r.nationkey""")
def join_multi_index(spark, sf):
    left = table(spark, sf, "customer").select(
        F.when(F.col("c_acctbal") <= 0, -1 - F.col("c_nationkey")).otherwise(F.col("c_nationkey")).alias("nationkey"),
        "c_custkey", "c_name")
    right = table(spark, sf, "nation").select(
        F.when(F.col("n_regionkey") == 1, 1000 + F.col("n_nationkey")).otherwise(F.col("n_nationkey")).alias("nationkey"),
        "n_regionkey", "n_name")
    lt = SetIndex(columns=["nationkey", "c_custkey"])(Table(left))
    rt = SetIndex(columns=["nationkey", "n_regionkey"])(Table(right))
    return Join(on="index", how="outer")(lt, rt).to_df()


# NULL keys on both sides pair up; the right side has one NULL key, so the
# NULL group stays linear in the left side
@query("join_null_keys", """
WITH l AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS nk FROM customer),
r AS (SELECT CASE WHEN n_nationkey = 0 THEN NULL ELSE n_nationkey END AS nkey, n_name FROM nation)
SELECT l.c_custkey, l.nk, r.nkey, r.n_name FROM l FULL OUTER JOIN r ON l.nk IS NOT DISTINCT FROM r.nkey""")
def join_null_keys(spark, sf):
    left = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("nk"))
    right = table(spark, sf, "nation").select(
        F.when(F.col("n_nationkey") == 0, F.lit(None)).otherwise(F.col("n_nationkey")).alias("nkey"), "n_name")
    return Join(left_on="nk", right_on="nkey", how="outer")(left, right)


# a third of lineitem on key 0 (one partner row) and a third on key -1 (no
# partner): full outer join with the hot keys split off and salted
SKEW_L = ("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_returnflag = 'R' THEN 0 "
          "WHEN l_returnflag = 'A' THEN -1 ELSE l_suppkey END AS k FROM lineitem")


@query("join_skewed_outer", f"""
WITH l AS ({SKEW_L}), r AS (SELECT CASE WHEN s_acctbal <= 0 THEN -1000 - s_suppkey ELSE s_suppkey END AS s_suppkey, s_name FROM supplier)
SELECT l.*, r.* FROM l FULL OUTER JOIN r ON l.k IS NOT DISTINCT FROM r.s_suppkey""")
def join_skewed_outer(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.when(F.col("l_returnflag") == "R", F.lit(0)).when(F.col("l_returnflag") == "A", F.lit(-1))
        .otherwise(F.col("l_suppkey")).alias("k"))
    su = table(spark, sf, "supplier").select(
        F.when(F.col("s_acctbal") <= 0, -1000 - F.col("s_suppkey")).otherwise(F.col("s_suppkey")).alias("s_suppkey"), "s_name")
    return Join(left_on="k", right_on="s_suppkey", how="outer", skew="auto", skew_min_rows=1000,
                salt_buckets=16)(li, su)
