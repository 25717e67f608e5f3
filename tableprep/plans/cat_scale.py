"""Queries for scaling and encoding: C1-C5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.convert import ToCategorical
from ..operators.encode import CategoryCodes, EpochMillis, OneHotEncoder, expand_onehot
from ..operators.scale import MinMaxScaler, StandardScaler
from .catalogue import query, r4, table


@query("minmax", """
WITH s AS (SELECT min(c_acctbal) AS a1, max(c_acctbal) AS b1, min(c_nationkey) AS a2, max(c_nationkey) AS b2
           FROM customer)
SELECT c_custkey, round((c_acctbal - a1) / (b1 - a1) * 2.0 + -1.0, 4) AS c_acctbal,
       round((c_nationkey - a2) / CAST(b2 - a2 AS DOUBLE) * 10.0 + 0.0, 4) AS c_nationkey
FROM customer, s""")
def minmax(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    out = MinMaxScaler(attributes={"c_acctbal": {"range": (-1, 1)}, "c_nationkey": {"range": (0, 10)}})(c)
    return out.select("c_custkey", r4("c_acctbal").alias("c_acctbal"), r4("c_nationkey").alias("c_nationkey"))


@query("minmax_constant", """
SELECT c_custkey, CASE WHEN c_nationkey >= 0 THEN CAST(2 AS DOUBLE) END AS flag FROM customer""")
def minmax_constant(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", (F.col("c_nationkey") >= 0).cast("double").alias("flag"))
    return MinMaxScaler(attributes={"flag": {"range": (2, 5)}})(c)


@query("standard", """
WITH s AS (SELECT avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1,
                  avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM part)
SELECT p_partkey, round((p_retailprice - m1) / s1, 4) AS p_retailprice, round((p_size - m2) / s2, 4) AS p_size
FROM part, s""")
def standard(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    out = StandardScaler(attributes=["p_retailprice", "p_size"])(p)
    return out.select("p_partkey", r4("p_retailprice").alias("p_retailprice"), r4("p_size").alias("p_size"))


SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("onehot", "SELECT c_custkey, c_mktsegment, " + ", ".join(
    f"CAST(coalesce(c_mktsegment = '{s}', false) AS INTEGER) AS c_mktsegment_{s}" for s in SEGS) + " FROM customer")
def onehot(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return OneHotEncoder(attributes=["c_mktsegment"])(c)


ONEHOT_NAN_SQL = """
WITH t AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)
SELECT c_custkey, seg, {cols}, CAST(seg IS NULL AS INTEGER) AS seg_nan FROM t"""


@query("onehot_nan", ONEHOT_NAN_SQL.format(cols=", ".join(
    f"CAST(coalesce(seg = '{s}', false) AS INTEGER) AS seg_{s}" for s in SEGS)))
def onehot_nan(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("seg"))
    return OneHotEncoder(attributes=["seg"], include_nan=True)(c)


PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("cat_codes", """
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1
  WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 END AS INTEGER) AS o_orderpriority FROM orders""")
def cat_codes(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    # declared order differs from text order; 1-URGENT is outside the list -> missing
    o = ToCategorical(attributes={"o_orderpriority": {"cat": ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH"],
                                                      "ordered": True}})(o)
    return CategoryCodes(attributes=["o_orderpriority"])(o)


@query("epoch_ms", "SELECT event_id, CAST(epoch_us(ts) AS DOUBLE) / 1000 AS ts FROM events")
def epoch_ms(spark, sf):
    return EpochMillis(attributes=["ts"])(table(spark, sf, "events").select("event_id", "ts"))


# thousands of values: one sparse column, and the columns of two of them
@query("onehot_sparse", """
WITH c AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n
           FROM (SELECT DISTINCT 'part ' || l_partkey AS v FROM lineitem)),
l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 6 THEN 'part ' || l_partkey END AS part FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST((SELECT max(n) + 1 FROM c) AS INTEGER) AS size,
       CAST(CASE WHEN part IS NULL THEN (SELECT max(n) FROM c) ELSE i END AS INTEGER) AS "index",
       CAST(coalesce(part = 'part 7', false) AS INTEGER) AS "part_part 7", CAST(coalesce(part = 'part 12', false) AS INTEGER) AS "part_part 12"
FROM l LEFT JOIN c ON c.v = part""")
def onehot_sparse(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("part "), "l_partkey").alias("part"))
    model = OneHotEncoder(attributes=["part"], output="sparse", include_nan=True).fit(li)
    out = model.transform(li.withColumn("part", F.when(F.col("l_linenumber") < 6, F.col("part"))))
    out = expand_onehot(out, "part_onehot", ["part 7", "part 12"])
    return out.select("l_orderkey", "l_linenumber", "part_onehot.size", "part_onehot.index", "`part_part 7`", "`part_part 12`")
