"""Step-graph queries (G1, G4): the flagship chain and a branch + join graph."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators.convert import ToCategorical
from ..operators.scale import MinMaxScaler
from ..step import register_step
from ..streaming import stream
from .cat_io import scratch
from .catalogue import query, r4, table
from .dag import StepGraph

FLAGSHIP_NODES = [
    {"id": "orders", "step": "input", "options": {"table": "orders"}},
    {"id": "customer", "step": "input", "options": {"table": "customer"}},
    {"id": "join", "step": "join", "inputs": ["orders", "customer"],
     "options": {"on": "columns", "left_on": "o_custkey", "right_on": "c_custkey", "how": "left"}},
    {"id": "fill", "step": "fill_nan", "inputs": ["join"],
     "options": {"method": "mean", "selected": ["price", "c_acctbal"]}},
    {"id": "scale", "step": "minmax_scaler", "inputs": ["fill"],
     "options": {"attributes": {"price": {"range": [0.0, 1.0]}}}},
    {"id": "bands", "step": "range_discretizer", "inputs": ["scale"],
     "options": {"table": {"price": {"bins": [0.0, 0.25, 0.5, 0.75, 1.0],
                                     "labels": ["low", "mid", "high", "top"]}},
                 "suffix": "_band"}},
]


def flagship_inputs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", F.lit(None)).otherwise(F.col("o_totalprice")).alias("price"))
    # a key turned negative gives a row without partner; every row is read
    customer = table(spark, sf_dir, "customer").select(
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("c_custkey"),
        "c_mktsegment", "c_acctbal")
    return {"orders": orders, "customer": customer}


@query("dag_flagship", """
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus,
                  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS price FROM orders),
c AS (SELECT CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN -c_custkey ELSE c_custkey END AS c_custkey, c_mktsegment, c_acctbal
      FROM customer),
j AS (SELECT * FROM o LEFT JOIN c ON o.o_custkey IS NOT DISTINCT FROM c.c_custkey),
f AS (SELECT o_orderkey, o_custkey, o_orderstatus, c_custkey, c_mktsegment,
             coalesce(price, avg(price) OVER ()) AS price,
             coalesce(c_acctbal, avg(c_acctbal) OVER ()) AS c_acctbal FROM j),
s AS (SELECT *, (price - min(price) OVER ()) / (max(price) OVER () - min(price) OVER ()) * 1.0 + 0.0 AS ps FROM f)
SELECT o_orderkey, o_custkey, o_orderstatus, c_custkey, c_mktsegment,
       round(ps, 4) AS price, round(c_acctbal, 4) AS c_acctbal,
       CASE WHEN ps > 0.0 AND ps <= 0.25 THEN 'low' WHEN ps > 0.25 AND ps <= 0.5 THEN 'mid'
            WHEN ps > 0.5 AND ps <= 0.75 THEN 'high' WHEN ps > 0.75 AND ps <= 1.0 THEN 'top' END AS price_band
FROM s
""")
def dag_flagship(spark, sf_dir):
    g = StepGraph(FLAGSHIP_NODES)
    results, _ = g.run(spark, flagship_inputs(spark, sf_dir))
    g.release()  # the result is lazy: nothing stays cached behind it
    df = results["bands"].to_df()
    return df.select("o_orderkey", "o_custkey", "o_orderstatus", "c_custkey", "c_mktsegment",
                     r4("price").alias("price"), r4("c_acctbal").alias("c_acctbal"), "price_band")


@query("dag_from_json", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END)"
       " / count(*) FILTER (o_orderstatus <> 'P'), 2) AS learned_mean FROM orders")
def dag_from_json(spark, sf_dir):
    """A graph saved as text, loaded, run, and its report read back."""
    g = StepGraph.from_json(StepGraph([
        {"id": "orders", "step": "input", "options": {"table": "orders"}},
        {"id": "fill", "step": "fill_nan", "inputs": ["orders"], "options": {"method": "mean", "selected": ["price"]}}]).to_json())
    results, report = g.run(spark, {"orders": flagship_inputs(spark, sf_dir)["orders"]})
    learned = [json.loads(v) for node, _, kind, key, v in report if (node, kind, key) == ("fill", "learned", "means")]
    return results["fill"].df.agg(F.count("price").alias("n")).select("n", F.round(F.lit(learned[0]["price"]), 2).alias("learned_mean"))


@query("dag_wide_saved", """
WITH ok AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS v FROM orders)),
ck AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM orders))
SELECT l_linenumber, l_orderkey, CAST(ok.code AS INTEGER) AS okey, CAST(ck.code AS INTEGER) AS cust
FROM lineitem LEFT JOIN ok ON ok.v = CAST(l_orderkey AS VARCHAR) LEFT JOIN ck ON ck.v = CAST(l_partkey AS VARCHAR)""")
def dag_wide_saved(spark, sf_dir):
    """A graph that learned codes of thousands of values, saved with its tables, loaded and applied to another table."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("okey"), F.col("o_custkey").cast("string").alias("cust"))
    g = StepGraph([{"id": "in", "step": "input", "options": {"table": "t"}},
                   {"id": "codes", "step": "category_codes", "inputs": ["in"], "options": {"attributes": ["okey", "cust"]}}])
    g.run(spark, {"t": orders})
    path = scratch(spark, "graph")
    g.save(spark, path, g.fitted)
    back = StepGraph.load(spark, path)
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_orderkey", F.col("l_orderkey").cast("string").alias("okey"),
                                                    F.col("l_partkey").cast("string").alias("cust"))
    results, _ = back.run(spark, {"t": lines}, fitted=back.saved_fitted)
    return results["codes"].to_df().select("l_linenumber", "l_orderkey", "okey", "cust")


BRANCH_NODES = [
    {"id": "orders", "step": "input", "options": {"table": "orders"}},
    {"id": "nation", "step": "input", "options": {"table": "nation"}},
    {"id": "customer", "step": "input", "options": {"table": "customer"}},
    {"id": "cust_nation", "step": "join", "inputs": ["customer", "nation"],
     "options": {"on": "columns", "left_on": "c_nationkey", "right_on": "n_nationkey", "how": "inner"}},
    {"id": "std", "step": "standard_scaler", "inputs": ["cust_nation"],
     "options": {"attributes": ["c_acctbal"]}},
    {"id": "prio", "step": "to_categorical", "inputs": ["orders"],
     "options": {"attributes": {"o_orderpriority": {
         "cat": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "ordered": True}}}},
    {"id": "codes", "step": "category_codes", "inputs": ["prio"],
     "options": {"attributes": ["o_orderpriority"]}},
    {"id": "both", "step": "join", "inputs": ["codes", "std"],
     "options": {"on": "columns", "left_on": "o_custkey", "right_on": "c_custkey", "how": "inner"}},
]


@query("dag_branch_join", """
WITH cn AS (SELECT c_custkey, c_acctbal, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
s AS (SELECT c_custkey, n_name, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z FROM cn)
SELECT o_orderkey, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
       WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS INTEGER) AS prio_code,
       n_name, round(z, 4) AS acctbal_z
FROM orders JOIN s ON o_custkey = c_custkey
""")
def dag_branch_join(spark, sf_dir):
    tabs = {"orders": table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"),
            "nation": table(spark, sf_dir, "nation").select("n_nationkey", "n_name"),
            "customer": table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")}
    g = StepGraph(BRANCH_NODES)
    results, _ = g.run(spark, tabs)
    g.release()
    df = results["both"].to_df()
    return df.select("o_orderkey", F.col("o_orderpriority").alias("prio_code"), "n_name",
                     r4("c_acctbal").alias("acctbal_z"))


@query("dag_report", """
SELECT 'orders' AS node, 'input' AS step, 'option' AS kind, 'source' AS key, '{"table": "orders"}' AS value
UNION ALL SELECT 'fill', 'fill_nan', 'option', 'method', '"mean"'
UNION ALL SELECT 'fill', 'fill_nan', 'option', 'selected', '["price"]'
UNION ALL SELECT 'fill', 'fill_nan', 'schema', 'columns', '["o_orderkey", "o_custkey", "o_orderstatus", "price"]'
UNION ALL SELECT 'out', 'output', 'result', 'rows', CAST(count(*) AS VARCHAR) FROM orders""")
def dag_report(spark, sf_dir):
    """What a run reports of options, schemas and results (G6; learned means are in dag_from_json)."""
    g = StepGraph([{"id": "orders", "step": "input", "options": {"table": "orders"}},
                   {"id": "fill", "step": "fill_nan", "inputs": ["orders"], "options": {"method": "mean", "selected": ["price"]}},
                   {"id": "out", "step": "output", "inputs": ["fill"], "options": {"name": "tp_report_out"}}])
    _, report = g.run(spark, {"orders": flagship_inputs(spark, sf_dir)["orders"]})
    return g.report_df(spark, report).where("kind <> 'learned'")


@query("user_step", "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders")
def user_step(spark, sf_dir):
    """A step of the user's own, registered by name and run in a graph (2.13)."""
    register_step("double_price", lambda df: df.withColumn("o_totalprice", F.col("o_totalprice") * 2))
    g = StepGraph([{"id": "in", "step": "input", "options": {"table": "t"}}, {"id": "twice", "step": "double_price", "inputs": ["in"]}])
    results, _ = g.run(spark, {"t": table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")})
    return results["twice"].to_df()


@query("stream_scaled", """
SELECT event_id, round((value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER ()), 4) AS value,
       CASE WHEN event_type IN ('click', 'view') THEN event_type END AS event_type FROM events""")
def stream_scaled(spark, sf_dir):
    """Steps fitted on a batch, applied to a stream of files, written through a streaming sink (2.14)."""
    batch = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    models = stream.fit_on_batch([MinMaxScaler(attributes={"value": {"range": [0, 1]}}),
                                  ToCategorical(attributes={"event_type": {"cat": ["click", "view"]}})], batch)
    src = scratch(spark, "stream-in")  # a stream reads a folder
    batch.write.parquet(src)
    path = scratch(spark, "stream-out")
    out = stream.apply_models(models, stream.read_parquet_stream(spark, src, batch.schema))
    query_ = (out.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch(spark, "stream-log"))
              .trigger(availableNow=True).start())
    query_.awaitTermination()
    return spark.read.parquet(path).select("event_id", r4("value").alias("value"), "event_type")
