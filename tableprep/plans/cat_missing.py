"""Queries for missing-value filters and fills: F1-F6, N1, N2, W1, W2."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import missing as M
from ..operators.columns import DropColumns, RenameColumns
from ..operators.discretize import BinsDiscretizer
from ..operators.encode import OneHotEncoder
from ..operators.fill import FillNan
from ..operators.scale import MinMaxScaler
from .catalogue import query, r4, table

# orders with NULLs injected by value predicates (the tables have none)
ORDERS_NULLS_SQL = """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price,
       CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority END AS prio,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS odate,
       CASE WHEN o_totalprice > 400000 THEN NULL ELSE o_orderstatus END AS status
FROM orders"""


def orders_nulls(spark, sf):
    o = table(spark, sf, "orders")
    nul = F.lit(None)
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", nul).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_totalprice") < 50000, nul).otherwise(F.col("o_orderpriority")).alias("prio"),
        F.when(F.col("o_orderpriority") == "5-LOW", nul).otherwise(F.col("o_orderdate")).alias("odate"),
        F.when(F.col("o_totalprice") > 400000, nul).otherwise(F.col("o_orderstatus")).alias("status"))


NULLS = ("(CAST(price IS NULL AS INT) + CAST(prio IS NULL AS INT) + CAST(odate IS NULL AS INT)"
         " + CAST(status IS NULL AS INT))")


@query("rows_nan_count", f"WITH t AS ({ORDERS_NULLS_SQL}) SELECT * FROM t WHERE {NULLS} <= 1")
def rows_nan_count(spark, sf):
    return M.RemoveNanRows(number=1)(orders_nulls(spark, sf))


@query("rows_nan_share", f"WITH t AS ({ORDERS_NULLS_SQL}) SELECT * FROM t WHERE {NULLS} <= 2")
def rows_nan_share(spark, sf):
    return M.RemoveNanRows(percentage=0.4)(orders_nulls(spark, sf))


# price is missing in ~1/3 of rows, the others in at most 1/5: the decision
# does not depend on scale
@query("cols_nan_count", f"WITH t AS ({ORDERS_NULLS_SQL}) SELECT o_orderkey FROM t")
def cols_nan_count(spark, sf):
    return M.RemoveNanColumns(number=0)(orders_nulls(spark, sf))


@query("cols_nan_share", f"WITH t AS ({ORDERS_NULLS_SQL}) SELECT o_orderkey, prio, odate, status FROM t")
def cols_nan_share(spark, sf):
    return M.RemoveNanColumns(percentage=0.3)(orders_nulls(spark, sf))


@query("drop_missing", f"WITH t AS ({ORDERS_NULLS_SQL}) SELECT * FROM t WHERE price IS NOT NULL AND odate IS NOT NULL")
def drop_missing(spark, sf):
    return M.DropMissing(subset=["price", "odate"])(orders_nulls(spark, sf))


@query("keep_index_values", """
SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def keep_index_values(spark, sf):
    ids = table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return M.keep_values_in(table(spark, sf, "orders"), "o_custkey", ids)


# events with NULLs: value missing for errors, type missing for low values,
# ts missing for a band of values
EVENTS_NULLS_SQL = """
SELECT event_id, user_id,
       CASE WHEN event_type = 'error' THEN NULL ELSE value END AS value,
       CASE WHEN value < 5 THEN NULL ELSE event_type END AS event_type,
       CASE WHEN value BETWEEN 10 AND 20 THEN NULL ELSE ts END AS ts
FROM events"""


def events_nulls(spark, sf):
    e = table(spark, sf, "events")
    nul = F.lit(None)
    return e.select(
        "event_id", "user_id",
        F.when(F.col("event_type") == "error", nul).otherwise(F.col("value")).alias("value"),
        F.when(F.col("value") < 5, nul).otherwise(F.col("event_type")).alias("event_type"),
        F.when(F.col("value").between(10, 20), nul).otherwise(F.col("ts")).alias("ts"))


@query("fill_value", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id, coalesce(value, 0.9) AS value, event_type,
       coalesce(ts, TIMESTAMP '1966-04-02 00:00:30') AS ts FROM t""")
def fill_value(spark, sf):
    return FillNan(method="value", selected={"value": 0.9, "ts": "1966-04-02 00:00:30"})(events_nulls(spark, sf))


@query("fill_mean", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id, round(coalesce(value, avg(value) OVER ()), 4) AS value, event_type, ts FROM t""")
def fill_mean(spark, sf):
    df = FillNan(method="mean", selected=["value"])(events_nulls(spark, sf))
    return df.select("event_id", "user_id", r4("value").alias("value"), "event_type", "ts")


@query("fill_mean_ts", f"""
WITH t AS ({EVENTS_NULLS_SQL}),
m AS (SELECT make_timestamp(CAST(floor(sum(CAST(epoch_us(ts) AS DECIMAL(38,0))) / count(ts)) AS BIGINT)) AS mts FROM t)
SELECT event_id, user_id, value, event_type, coalesce(ts, mts) AS ts FROM t, m""")
def fill_mean_ts(spark, sf):
    return FillNan(method="mean", selected=["ts"])(events_nulls(spark, sf))


FW = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BW = "OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
FWU = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


BWU = "OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@query("ffill_global", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id, last_value(value IGNORE NULLS) {FW} AS value,
       last_value(event_type IGNORE NULLS) {FW} AS event_type, last_value(ts IGNORE NULLS) {FW} AS ts FROM t""")
def ffill_global(spark, sf):
    return FillNan(method="ffill", selected=["value", "event_type", "ts"], order_by="event_id")(
        events_nulls(spark, sf))


@query("ffill_by_user", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id, last_value(value IGNORE NULLS) {FWU} AS value,
       last_value(event_type IGNORE NULLS) {FWU} AS event_type, ts FROM t""")
def ffill_by_user(spark, sf):
    return FillNan(method="ffill", selected=["value", "event_type"], order_by="event_id",
                   partition_by=["user_id"])(events_nulls(spark, sf))


@query("bfill_global", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id, first_value(value IGNORE NULLS) {BW} AS value,
       first_value(event_type IGNORE NULLS) {BW} AS event_type, first_value(ts IGNORE NULLS) {BW} AS ts FROM t""")
def bfill_global(spark, sf):
    return FillNan(method="bfill", selected=["value", "event_type", "ts"], order_by="event_id")(
        events_nulls(spark, sf))


@query("bfill_by_user", f"""
WITH t AS ({EVENTS_NULLS_SQL})
SELECT event_id, user_id, first_value(value IGNORE NULLS) {BWU} AS value,
       first_value(event_type IGNORE NULLS) {BWU} AS event_type, ts FROM t""")
def bfill_by_user(spark, sf):
    return FillNan(method="bfill", selected=["value", "event_type"], order_by="event_id", partition_by=["user_id"],
                   ranges=7)(events_nulls(spark, sf))


# one row has no order key: it comes first, and its value is carried on
NULL_KEY_SQL = f"""
SELECT CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN NULL ELSE event_id END AS k, event_id,
       CASE WHEN event_id < 50 THEN NULL ELSE value END AS value,
       CASE WHEN event_id < 70 THEN NULL ELSE event_type END AS event_type FROM ({EVENTS_NULLS_SQL})"""


@query("ffill_null_key", f"""
WITH t AS ({NULL_KEY_SQL})
SELECT k, event_id, last_value(value IGNORE NULLS) OVER w AS value, last_value(event_type IGNORE NULLS) OVER w AS event_type
FROM t WINDOW w AS (ORDER BY k ASC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ffill_null_key(spark, sf):
    e = events_nulls(spark, sf)
    last = e.agg(F.max("event_id").alias("last"))
    t = e.join(F.broadcast(last)).select(  # one row
        F.when(F.col("event_id") != F.col("last"), F.col("event_id")).alias("k"), "event_id",
        F.when(F.col("event_id") >= 50, F.col("value")).alias("value"),
        F.when(F.col("event_id") >= 70, F.col("event_type")).alias("event_type"))
    return FillNan(method="ffill", selected=["value", "event_type"], order_by="k")(t)


# NaN and NULL together: both are missing, whichever way a table comes in
def _nan_events(spark, sf):
    e = spark.read.parquet(f"{sf.rstrip('/')}/events.parquet")
    return e.select("event_id", F.when(F.col("event_type") == "error", F.lit(float("nan")))
                    .when(F.col("event_type") != "signup", F.col("value")).alias("x"),
                    F.when(F.col("value") < 20, F.lit(float("nan"))).otherwise(F.col("value")).alias("y"))


NAN_SQL = """SELECT event_id, CASE WHEN event_type NOT IN ('error', 'signup') THEN value END AS x,
                    CASE WHEN value >= 20 THEN value END AS y FROM events"""


@query("nan_fill_mean", f"""
WITH t AS ({NAN_SQL})
SELECT event_id, round(coalesce(x, avg(x) OVER ()), 4) AS x, y FROM t""")
def nan_fill_mean(spark, sf):
    return FillNan(method="mean", selected=["x"])(_nan_events(spark, sf)).select("event_id", r4("x").alias("x"), "y")


@query("nan_minmax", f"""
WITH t AS ({NAN_SQL})
SELECT event_id, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 4) AS x, y FROM t""")
def nan_minmax(spark, sf):
    out = MinMaxScaler(attributes={"x": {"range": (0, 1)}})(_nan_events(spark, sf))
    return out.select("event_id", r4("x").alias("x"), "y")


@query("nan_rows", f"SELECT * FROM ({NAN_SQL}) WHERE x IS NOT NULL AND y IS NOT NULL")
def nan_rows(spark, sf):
    return M.RemoveNanRows(number=0)(_nan_events(spark, sf))


# a row of 100 cells with 29 missing has a share of exactly 0.29 and stays
@query("rows_share_exact", """
WITH t AS (SELECT l_orderkey, l_linenumber, 25 + l_orderkey % 9 AS gaps FROM lineitem)
SELECT l_orderkey, l_linenumber FROM t WHERE gaps <= 29""")
def rows_share_exact(spark, sf):
    t = table(spark, sf, "lineitem")
    gaps = 25 + F.col("l_orderkey") % 9
    wide = t.select("l_orderkey", "l_linenumber", *[F.when(gaps <= j, F.lit(1)).alias(f"c{j}") for j in range(98)])
    return M.RemoveNanRows(percentage=0.29)(wide).select("l_orderkey", "l_linenumber")


# names with dots through a chain of steps
@query("dotted_names", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem),
s AS (SELECT min(q) AS mn, (max(q) - min(q)) / 2 AS w FROM t)
SELECT l_orderkey, l_linenumber, round((q - mn) / (2 * w), 4) AS qty,
       CAST(q + (1e-8 + 1e-5 * q) < mn + w AS INTEGER) AS low, CAST(q + (1e-8 + 1e-5 * q) >= mn + w AS INTEGER) AS high
FROM t, s""")
def dotted_names(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("qty.raw"))
    t = BinsDiscretizer(attributes={"qty.raw": {"bins": 2}}, strategy="uniform", suffix="#")(t)
    t = RenameColumns(names={"qty.raw#": "qty.bin"})(t)
    t = M.DropMissing()(OneHotEncoder(attributes=["qty.bin"])(t))
    t = DropColumns(columns=["qty.bin"])(MinMaxScaler(attributes={"qty.raw": {"range": (0, 1)}})(t))
    return t.select("l_orderkey", "l_linenumber", F.round(F.col("`qty.raw`"), 4).alias("qty"),
                    F.col("`qty.bin_0.0`").alias("low"), F.col("`qty.bin_1.0`").alias("high"))
