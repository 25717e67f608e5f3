"""Queries for reshaping (X1) and chart data (V1, V2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.chartdata import scatter_data, series_data
from ..operators.columns import SetIndex
from ..operators.convert import ToCategorical
from ..operators.reshape import extract_series
from ..table import Table
from .catalogue import query, r4, table
from .cat_missing import EVENTS_NULLS_SQL, events_nulls

YEARS = list(range(1995, 2002))


def _wide(spark, sf, status, agg, prefix):
    """Orders per order year, one row per customer (negative for the orders of other statuses)."""
    o = (table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
         .withColumn("o_custkey", F.when(F.col("o_orderstatus") != status, -F.col("o_custkey")).otherwise(F.col("o_custkey"))))
    w = o.groupBy("o_custkey").pivot("yr", YEARS).agg(agg)
    return w.select("o_custkey", *[F.col(str(y)).alias(f"{prefix}{y}") for y in YEARS])


WIDE_SQL = """
SELECT CASE WHEN o_orderstatus <> '{st}' THEN -o_custkey ELSE o_custkey END AS o_custkey, {body} FROM orders GROUP BY 1"""


def _wide_sql(st, fn, prefix):
    body = ", ".join(f"{fn.format(y=y)} AS {prefix}{y}" for y in YEARS)
    return WIDE_SQL.format(body=body, st=st)


SUM_F = "sum(o_totalprice) FILTER (WHERE year(o_orderdate) = {y})"
CNT_F = "CASE WHEN count(*) FILTER (WHERE year(o_orderdate) = {y}) > 0 THEN count(*) FILTER (WHERE year(o_orderdate) = {y}) END"


@query("extract_series_one", f"""
WITH f AS ({_wide_sql('F', SUM_F, 'f')}),
y AS (SELECT CAST(range AS VARCHAR) AS time FROM range(1995, 2002))
SELECT f.o_custkey, y.time, round(CASE {' '.join(f"WHEN y.time = '{yy}' THEN f.f{yy}" for yy in YEARS)} END, 4)
       AS spend
FROM f CROSS JOIN y""")
def extract_series_one(spark, sf):
    f = SetIndex(columns=["o_custkey"])(Table(_wide(spark, sf, "F", F.sum("o_totalprice"), "f")))
    t = extract_series({"F": f}, {"spend": [("F", f"f{y}", str(y)) for y in YEARS]}, [str(y) for y in YEARS])
    df = t.to_df()
    return df.select("o_custkey", "time", r4("spend").alias("spend"))


@query("extract_series_two_frames", f"""
WITH f AS ({_wide_sql('F', SUM_F, 'f')}),
g AS ({_wide_sql('O', CNT_F, 'g')}),
ids AS (SELECT o_custkey FROM f UNION SELECT o_custkey FROM g),
y AS (SELECT CAST(range AS VARCHAR) AS time FROM range(1995, 2002))
SELECT ids.o_custkey, y.time,
  round(CASE {' '.join(f"WHEN y.time = '{yy}' THEN f.f{yy}" for yy in YEARS[:4])}
             {' '.join(f"WHEN y.time = '{yy}' THEN CAST(g.g{yy} AS DOUBLE)" for yy in YEARS[4:])} END, 4) AS mixed,
  CAST(CASE {' '.join(f"WHEN y.time = '{yy}' THEN g.g{yy}" for yy in YEARS)} END AS DOUBLE) AS o_count
FROM ids CROSS JOIN y LEFT JOIN f ON f.o_custkey = ids.o_custkey LEFT JOIN g ON g.o_custkey = ids.o_custkey""")
def extract_series_two_frames(spark, sf):
    f = SetIndex(columns=["o_custkey"])(Table(_wide(spark, sf, "F", F.sum("o_totalprice"), "f")))
    g = SetIndex(columns=["o_custkey"])(Table(_wide(spark, sf, "O", F.count(F.lit(1)), "g")))
    series = {"mixed": [("F", f"f{y}", str(y)) for y in YEARS[:4]] + [("G", f"g{y}", str(y)) for y in YEARS[4:]],
              "o_count": [("G", f"g{y}", str(y)) for y in YEARS]}
    t = extract_series({"F": f, "G": g}, series, [str(y) for y in YEARS])
    df = t.to_df()
    return df.select("o_custkey", "time", r4("mixed").alias("mixed"), "o_count")


@query("scatter_data", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT value, CAST(epoch_us(ts) AS DOUBLE) / 1000 AS ts,
       CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
            WHEN 'view' THEN 4 END AS DOUBLE) AS event_type, event_type AS kind
FROM t WHERE value IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL""")
def scatter_q(spark, sf):
    e = events_nulls(spark, sf).withColumn("kind", F.col("event_type"))
    e = ToCategorical(attributes={"event_type": {"cat": ["click", "error", "purchase", "signup", "view"]}})(e)
    return scatter_data(e, ["value", "ts", "event_type"], colour="kind")


@query("series_data", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT * FROM (
  SELECT 'value' AS series, CAST(epoch_us(ts) AS DOUBLE) / 1000 AS t, value FROM t
  UNION ALL SELECT 'user_id', CAST(epoch_us(ts) AS DOUBLE) / 1000, CAST(user_id AS DOUBLE) FROM t)
WHERE t IS NOT NULL""")
def series_q(spark, sf):
    return series_data(events_nulls(spark, sf), "ts", ["value", "user_id"])


@query("series_by_id", """
SELECT CAST(user_id AS VARCHAR) AS series, CAST(epoch_us(ts) AS DOUBLE) / 1000 AS t, value FROM events""")
def series_by_id(spark, sf):
    """A8 + V2 by ids: the series of every user."""
    ev = table(spark, sf, "events")
    t = SetIndex(columns=["user_id"])(Table(ev.select("user_id", "ts", "value")))
    return series_data(t, "ts", ["value"], ids=ev.select("user_id").distinct())
