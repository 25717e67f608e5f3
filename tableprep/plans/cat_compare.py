"""Queries for table comparison: U2-U4."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.compare import RemoveDuplicateColumns, table_diff, table_equal
from .catalogue import query, table

# supplier with copies: an exact copy of s_name, s_nationkey as double (equal
# as numbers), and a near copy of s_acctbal that differs where s_nationkey = 3
DUP_SQL = """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal
FROM supplier"""


def _supplier_dupes(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal",
                    F.col("s_name").alias("name_copy"),
                    F.col("s_nationkey").cast("double").alias("nation_double"),
                    F.when(F.col("s_nationkey") == 3, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))
                    .alias("acct_near"))


@query("drop_duplicate_cols", """
SELECT s_suppkey, s_name, s_nationkey, s_acctbal,
       CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS acct_near FROM supplier""")
def drop_duplicate_cols(spark, sf):
    df = _supplier_dupes(spark, sf)
    return RemoveDuplicateColumns(attributes=df.columns)(df)


def _supplier_changed(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey",
                    F.when(F.col("s_acctbal") < 0, F.concat(F.col("s_name"), F.lit("*"))).otherwise(
                        F.col("s_name")).alias("s_name"),
                    "s_nationkey",
                    F.when(F.col("s_nationkey") == 3, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))
                    .alias("s_acctbal"))


@query("table_diff", """
SELECT s_suppkey, 's_name' AS "column", s_name AS "left", s_name || '*' AS "right" FROM supplier WHERE s_acctbal < 0
UNION ALL
SELECT s_suppkey, 's_acctbal', CAST(s_acctbal AS VARCHAR), CAST(s_acctbal + 1 AS VARCHAR) FROM supplier
WHERE s_nationkey = 3""")
def table_diff_q(spark, sf):
    return table_diff(table(spark, sf, "supplier"), _supplier_changed(spark, sf), "s_suppkey")


@query("table_equal_same", """
SELECT count(*) = 0 AS equal FROM (
  (SELECT s_suppkey, s_acctbal, s_name FROM supplier EXCEPT ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier)
  UNION ALL (SELECT s_suppkey, s_acctbal, s_name FROM supplier EXCEPT ALL SELECT s_suppkey, s_acctbal, s_name FROM supplier))""")
def table_equal_same(spark, sf):
    s = table(spark, sf, "supplier")
    return table_equal(s, s.select(*reversed(s.columns)))


@query("table_equal_changed", """
WITH c AS (SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN s_name || '*' ELSE s_name END AS s_name, s_nationkey,
  CASE WHEN s_nationkey = 3 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier),
s AS (SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier)
SELECT count(*) = 0 AS equal FROM ((SELECT * FROM s EXCEPT ALL SELECT * FROM c) UNION ALL (SELECT * FROM c EXCEPT ALL SELECT * FROM s))""")
def table_equal_changed(spark, sf):
    return table_equal(table(spark, sf, "supplier"), _supplier_changed(spark, sf))


# long texts: an edit here and there, a row left out, one added
@query("table_diff_documents", """
WITH c AS (SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN text || '.' ELSE text END AS text,
                  CASE WHEN source IS NULL OR lang = 'es' AND doc_id % 7 = 0 THEN 'edited' ELSE source END AS source FROM documents WHERE doc_id <> 5
           UNION ALL SELECT -1, 'new', 'new'),
d AS (SELECT doc_id, text, source FROM documents),
j AS (SELECT coalesce(d.doc_id, c.doc_id) AS doc_id, d.doc_id AS l, c.doc_id AS r, d.text AS lt, c.text AS rt, d.source AS ls, c.source AS rs
      FROM d FULL JOIN c ON d.doc_id = c.doc_id)
SELECT doc_id, 'text' AS "column", md5(lt) AS "left", md5(rt) AS "right" FROM j WHERE l IS NULL OR r IS NULL OR lt IS DISTINCT FROM rt
UNION ALL
SELECT doc_id, 'source', md5(ls), md5(rs) FROM j WHERE l IS NULL OR r IS NULL OR ls IS DISTINCT FROM rs""")
def table_diff_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "source")
    c = table(spark, sf, "documents").where("doc_id <> 5").select(
        "doc_id", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"),
        F.when(F.col("source").isNull() | ((F.col("lang") == "es") & (F.col("doc_id") % 7 == 0)), "edited").otherwise(F.col("source")).alias("source"))
    c = c.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("new").alias("text"), F.lit("new").alias("source")))
    return table_diff(d, c, "doc_id").withColumns({x: F.md5(F.col(x).cast("binary")) for x in ("left", "right")})


@query("table_equal_documents", """
SELECT 'same' AS what, true AS equal UNION ALL SELECT 'one text changed', false UNION ALL SELECT 'one row twice', false""")
def table_equal_documents(spark, sf):
    d = table(spark, sf, "documents")
    first = d.agg(F.min("doc_id").alias("first"))
    changed = d.join(F.broadcast(first), F.col("doc_id") == F.col("first"), "left").withColumn(
        "text", F.when(F.col("first").isNotNull(), F.concat(F.col("text"), F.lit(" "))).otherwise(F.col("text"))).drop("first")
    twice = d.unionByName(d.join(F.broadcast(first), F.col("doc_id") == F.col("first")).drop("first"))
    tests = {"same": d.select(*reversed(d.columns)), "one text changed": changed, "one row twice": twice}
    out = None
    for what, other in tests.items():
        one = table_equal(d, other).select(F.lit(what).alias("what"), "equal")
        out = one if out is None else out.unionByName(one)
    return out
