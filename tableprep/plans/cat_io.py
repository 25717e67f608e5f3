"""Queries for sources and sinks: S1, S5-S8, S9, S10, S12.

Files are written under the cluster's shared checkpoint folder
(``spark.checkpoint.dir``), never a machine-local temporary folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.convert import ToCategorical
from ..operators.encode import CategoryCodes
from ..session import ensure_checkpoint_dir
from ..sources import catalog, parquet
from ..sources import csv as csvsrc
from .catalogue import query, table


def scratch(spark, what: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tableprep-io/{what}-{uuid.uuid4().hex}"


@query("csv_roundtrip", """
SELECT CAST(c_custkey AS DOUBLE) AS c_custkey, c_name, CAST(c_nationkey AS DOUBLE) AS c_nationkey,
       c_acctbal, c_mktsegment FROM customer""")
def csv_roundtrip(spark, sf):
    path = scratch(spark, "customer-csv")
    csvsrc.write_csv(table(spark, sf, "customer"), path, sep="semicolon", index=False)
    return csvsrc.read_csv(spark, path, sep=";")


@query("parquet_types_roundtrip", """
SELECT c_custkey, c_mktsegment, CAST(CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'HOUSEHOLD' THEN 1
  WHEN 'FURNITURE' THEN 2 WHEN 'BUILDING' THEN 3 WHEN 'AUTOMOBILE' THEN 4 END AS INTEGER) AS code
FROM customer""")
def parquet_types_roundtrip(spark, sf):
    cats = ["MACHINERY", "HOUSEHOLD", "FURNITURE", "BUILDING", "AUTOMOBILE"]
    c = ToCategorical(attributes={"c_mktsegment": {"cat": cats, "ordered": True}})(
        table(spark, sf, "customer").select("c_custkey", "c_mktsegment"))
    path = scratch(spark, "customer-parquet")
    parquet.write_table(c, path)
    back = parquet.read_parquet(spark, path)  # categories come back from the footer
    coded = CategoryCodes(attributes=["c_mktsegment"])(back.withColumn("code", F.col("c_mktsegment")))
    return coded.select("c_custkey", F.col("code").alias("c_mktsegment_txt"), "c_mktsegment").select(
        "c_custkey", F.col("c_mktsegment_txt").alias("c_mktsegment"), F.col("c_mktsegment").alias("code"))


@query("named_table", "SELECT * FROM orders")
def named_table(spark, sf):
    catalog.to_variable(table(spark, sf, "orders"), "tp_orders")
    return catalog.set_input(spark, "tp_orders").to_df()


@query("named_table_documents", "SELECT * FROM documents")
def named_table_documents(spark, sf):
    catalog.to_variable(table(spark, sf, "documents"), "tp_documents")
    return catalog.set_input(spark, "tp_documents").to_df()


@query("head_page", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 400 OFFSET 100")
def head_page(spark, sf):
    return catalog.head(table(spark, sf, "orders"), n=400, offset=100, order_by="o_orderkey")


# a page deep in the table, in an order with ties and missing keys
@query("head_page_deep", """
SELECT l_orderkey, l_linenumber, k FROM (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice END AS k FROM lineitem)
ORDER BY k NULLS FIRST, l_orderkey, l_linenumber LIMIT 500 OFFSET 40000""")
def head_page_deep(spark, sf):
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("k"))
    return catalog.head(t, n=500, offset=40_000, order_by=["k", "l_orderkey", "l_linenumber"])


# texts with quotes, commas, line ends and padding go through a file unchanged
@query("csv_text_exact", """
SELECT doc_id::DOUBLE AS doc_id, '  "' || text || chr(10) || ', ""x"" ' AS text, doc_id % 3 = 0 AS flag FROM documents""")
def csv_text_exact(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit('  "'), F.col("text"), F.lit('\n, ""x"" ')).alias("text"), (F.col("doc_id") % 3 == 0).alias("flag"))
    path = scratch(spark, "documents-csv")
    csvsrc.write_csv(d, path, index=False)
    return csvsrc.read_csv(spark, path)


LARGE_FILE = 256 << 20  # bytes: one task writes a file


# a large file whose cells are full of line ends, read in splits
@query("csv_multiline_split", """
SELECT doc_id::DOUBLE AS doc_id, replace(text, ' ', chr(10)) || '"' AS text, lang FROM documents""")
def csv_multiline_split(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.translate("text", " ", "\n"), F.lit('"')).alias("text"), "lang")
    path = scratch(spark, "documents-lines")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # the test of the reader: one large file, and more only where each is larger than several splits
    csvsrc.write_csv(d.coalesce(max(1, size // LARGE_FILE)), path, index=False)
    return csvsrc.read_csv(spark, path)


@query("csv_schema", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value, event_type FROM events""")
def csv_schema(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"), "event_type")
    path = scratch(spark, "events-csv")
    csvsrc.write_csv(e, path, index=False, nan="NaN", ffloat="repr", max_records_per_file=500)
    return csvsrc.read_csv(spark, path, schema="event_id long, value double, event_type string")


@query("csv_floats", """
SELECT l_orderkey, l_linenumber, printf('%.2f', (l_orderkey * 125 + l_linenumber) / 1000.0::DOUBLE) AS a,
       CASE WHEN l_linenumber = 1 THEN 'inf' ELSE printf('%.3f', l_quantity::DOUBLE / 16) END AS b FROM lineitem""")
def csv_floats(spark, sf):
    t = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "(l_orderkey * 125 + l_linenumber) / 1000.0D AS a",
        "CASE WHEN l_linenumber = 1 THEN double('Infinity') ELSE l_quantity / 16 END AS b")
    return t.select("l_orderkey", "l_linenumber", csvsrc.float_format_expr(F.col("a"), "%.2f").alias("a"),
                    csvsrc.float_format_expr(F.col("b"), "%.3f").alias("b"))
