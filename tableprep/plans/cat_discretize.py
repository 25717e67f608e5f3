"""Queries for discretising: D1-D7."""

from __future__ import annotations

from ..operators.discretize import BinsDiscretizer, DateDiscretizer, RangeDiscretizer
from .catalogue import query, table
from .cat_missing import ORDERS_NULLS_SQL, orders_nulls


def _lab(expr):
    return f"CAST(CAST({expr} AS DOUBLE) AS VARCHAR)"


def _count(value, edges):
    """How many edges lie at or below the value, edges met within 1e-8 + 1e-5 of its size included."""
    return "(" + " + ".join(f"CAST({value} + (1e-8 + 1e-5 * abs({value})) >= {e} AS INT)" for e in edges) + ")"


# tenths from 0 to 1: every value lies on an edge, up to rounding
@query("bins_edges", """
WITH t AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 11) / 10.0::DOUBLE AS x, l_orderkey % 11 AS j FROM lineitem)
SELECT l_orderkey, l_linenumber, x, CAST(CAST(least(j, 9) AS DOUBLE) AS VARCHAR) AS x_bin FROM t""")
def bins_edges(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "(l_orderkey % 11) / 10.0D AS x")
    return BinsDiscretizer(attributes={"x": {"bins": 10}}, strategy="uniform", suffix="_bin")(t)


@query("bins_uniform", f"""
WITH s AS (SELECT min(l_extendedprice) AS mn1, (max(l_extendedprice) - min(l_extendedprice)) / 5 AS w1,
                  min(l_quantity) AS mn2, (max(l_quantity) - min(l_quantity)) / 4 AS w2 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity,
       {_lab(_count("l_extendedprice", [f"{j} * w1 + mn1" for j in range(1, 5)]))} AS l_extendedprice_bin,
       {_lab(_count("l_quantity", [f"{j} * w2 + mn2" for j in range(1, 4)]))} AS l_quantity_bin
FROM lineitem, s""")
def bins_uniform(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return BinsDiscretizer(attributes={"l_extendedprice": {"bins": 5}, "l_quantity": {"bins": 4}},
                           strategy="uniform", suffix="_bin")(li)


@query("bins_quantile", f"""
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, l_extendedprice,
       {_lab(_count("l_extendedprice", ["e[1]", "e[2]", "e[3]"]))} AS l_extendedprice
FROM lineitem, q""".replace("l_extendedprice,\n", "l_extendedprice AS price,\n"))
def bins_quantile(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    li = li.select("*", li["l_extendedprice"].alias("price"))
    return BinsDiscretizer(attributes={"l_extendedprice": {"bins": 4}}, strategy="quantile")(li)


# Lloyd's rounds as a recursive query over the distinct values: uniform start, ties to the lower centre
@query("bins_kmeans", """
WITH RECURSIVE v AS (SELECT CAST(l_quantity AS DOUBLE) AS v, count(*) AS n FROM lineitem GROUP BY 1),
mm AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
it AS (
  SELECT 0 AS r, lo + (hi - lo) / 6 AS a, lo + (hi - lo) / 2 AS b, lo + (hi - lo) * 5 / 6 AS c FROM mm
  UNION ALL
  SELECT r + 1, coalesce(sum(v * n) FILTER (v <= (a + b) / 2) / sum(n) FILTER (v <= (a + b) / 2), a),
         coalesce(sum(v * n) FILTER (v > (a + b) / 2 AND v <= (b + c) / 2) / sum(n) FILTER (v > (a + b) / 2 AND v <= (b + c) / 2), b),
         coalesce(sum(v * n) FILTER (v > (b + c) / 2) / sum(n) FILTER (v > (b + c) / 2), c)
  FROM it, v WHERE r < 60 GROUP BY r, a, b, c),
e AS (SELECT (a + b) / 2 AS x, (b + c) / 2 AS y FROM it WHERE r = 60)
SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity + (1e-8 + 1e-5 * abs(l_quantity)) >= y THEN '2.0'
  WHEN l_quantity + (1e-8 + 1e-5 * abs(l_quantity)) >= x THEN '1.0' ELSE '0.0' END AS l_quantity_km FROM lineitem, e""")
def bins_kmeans(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return BinsDiscretizer(attributes={"l_quantity": {"bins": 3}}, strategy="kmeans", suffix="_km")(li)


@query("ranges", """
SELECT p_partkey, p_retailprice, p_size,
  CASE WHEN p_retailprice > 900 AND p_retailprice <= 925 THEN 'a' WHEN p_retailprice > 925 AND p_retailprice <= 950
  THEN 'b' WHEN p_retailprice > 950 AND p_retailprice <= 975 THEN 'c' WHEN p_retailprice > 975 AND p_retailprice <= 1000
  THEN 'd' END AS p_retailprice_bins,
  CASE WHEN p_size > 0 AND p_size <= 10 THEN 'S' WHEN p_size > 10 AND p_size <= 30 THEN 'M'
  WHEN p_size > 30 AND p_size <= 45 THEN 'L' END AS p_size_bins
FROM part""")
def ranges(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return RangeDiscretizer(table={"p_retailprice": {"bins": [900, 925, 950, 975, 1000], "labels": list("abcd")},
                                   "p_size": {"bins": [0, 10, 30, 45], "labels": ["S", "M", "L"]}})(p)


@query("date_ranges", """
SELECT o_orderkey, o_orderdate,
  CASE WHEN o_orderdate > TIMESTAMP '1995-01-01' AND o_orderdate <= TIMESTAMP '1997-01-01' THEN 'early'
       WHEN o_orderdate > TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1999-01-01' THEN 'mid'
       WHEN o_orderdate > TIMESTAMP '1999-01-01' AND o_orderdate <= TIMESTAMP '2001-03-31' THEN 'late' END
  AS o_orderdate_discr
FROM orders""")
def date_ranges(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return DateDiscretizer(selected={"o_orderdate": {
        "ranges": (["1995-01-01 08:00:00", "1997-01-01", "1999-01-01 23:00:00", "2001-03-31"], True, False),
        "labels": ["early", "mid", "late"]}})(o)


@query("datetime_ranges", """
SELECT event_id, ts,
  CASE WHEN ts > TIMESTAMP '2024-01-01 00:00:00' AND ts <= TIMESTAMP '2024-01-10 12:00:00' THEN 'first'
       WHEN ts > TIMESTAMP '2024-01-10 12:00:00' AND ts <= TIMESTAMP '2024-01-20 06:30:00' THEN 'second'
       WHEN ts > TIMESTAMP '2024-01-20 06:30:00' AND ts <= TIMESTAMP '2024-02-01 00:00:00' THEN 'third' END
  AS ts_discr
FROM events""")
def datetime_ranges(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return DateDiscretizer(selected={"ts": {
        "ranges": (["2024-01-01 00:00:00", "2024-01-10 12:00:00", "2024-01-20 06:30:00", "2024-02-01 00:00:00"],
                   True, True),
        "labels": ["first", "second", "third"]}})(e)


TOD = "(floor((epoch_us(ts) - epoch_us(date_trunc('day', ts))) / 1000) * 1000)"


def _us(h, m, s=0):
    return ((h * 60 + m) * 60 + s) * 1_000_000


@query("time_ranges", f"""
SELECT event_id, ts,
  CASE WHEN {TOD} > {_us(0, 0)} AND {TOD} <= {_us(6, 0)} THEN 'night1'
       WHEN {TOD} > {_us(6, 0)} AND {TOD} <= {_us(12, 0)} THEN 'morning'
       WHEN {TOD} > {_us(12, 0)} AND {TOD} <= {_us(16, 40, 2)} THEN 'afternoon'
       WHEN {TOD} > {_us(16, 40, 2)} AND {TOD} <= {_us(22, 0)} THEN 'evening'
       WHEN {TOD} > {_us(22, 0)} AND {TOD} <= {_us(23, 59)} THEN 'night2' END AS ts_discr
FROM events""")
def time_ranges(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    return DateDiscretizer(selected={"ts": {
        "ranges": (["00:00", "06:00", "12:00", "16:40:02", "22:00", "23:59"], False, True),
        "labels": ["night1", "morning", "afternoon", "evening", "night2"]}})(e)


@query("bins_uniform_nulls", f"""
WITH t AS ({ORDERS_NULLS_SQL}),
s AS (SELECT min(price) AS mn, (max(price) - min(price)) / 4 AS w FROM t)
SELECT o_orderkey, price,
       CASE WHEN price IS NOT NULL THEN {_lab(_count("price", [f"{j} * w + mn" for j in range(1, 4)]))} END AS price_bin
FROM t, s""")
def bins_uniform_nulls(spark, sf):
    o = orders_nulls(spark, sf).select("o_orderkey", "price")
    return BinsDiscretizer(attributes={"price": {"bins": 4}}, strategy="uniform", suffix="_bin")(o)
