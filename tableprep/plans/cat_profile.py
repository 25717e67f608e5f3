"""Queries for profiles: A1-A7, A10."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.convert import ToCategorical
from .catalogue import query, r4, table
from .cat_missing import ORDERS_NULLS_SQL, orders_nulls

LINE_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax"]


def _num_sql(c):
    return (f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS missing, "
            f"round(100.0 * (count(*) - count({c})) / count(*), 4) AS missing_pct, "
            f"round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS q25, "
            f"round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, "
            f"round(CAST(max({c}) AS DOUBLE), 4) AS max FROM lineitem")


NUM_OUT = ["column", "rows", "missing", "missing_pct", "mean", "std", "min", "q25", "q50", "q75", "max"]


@query("stats_numeric", " UNION ALL ".join(_num_sql(c) for c in LINE_NUM))
def stats_numeric(spark, sf):
    s = P.column_stats(table(spark, sf, "lineitem"), LINE_NUM)
    return s.select("column", "rows", "missing", *[r4(c).alias(c) for c in NUM_OUT[3:]])


def _str_sql(tab, c, cast=""):
    v = f"CAST({c} AS VARCHAR)" if cast else c
    return (f"SELECT '{c}' AS \"column\", (SELECT count(*) FROM {tab}) AS rows, "
            f"(SELECT count(*) - count({c}) FROM {tab}) AS missing, "
            f"CAST(count(*) AS BIGINT) AS \"unique\", "
            f"arg_min(value, (-n, value)) AS top, CAST(max(n) AS BIGINT) AS top_count "
            f"FROM (SELECT {v} AS value, count(*) AS n FROM {tab} WHERE {c} IS NOT NULL GROUP BY 1)")


@query("stats_string", " UNION ALL ".join(_str_sql("part", c) for c in ["p_name", "p_brand", "p_type"]))
def stats_string(spark, sf):
    s = P.column_stats(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])
    return s.select("column", "rows", "missing", "unique", "top", "top_count")


@query("stats_datetime", _str_sql("orders", "o_orderdate", cast=True).replace(
    "AS top_count ", "AS top_count, (SELECT min(o_orderdate) FROM orders) AS first, "
                     "(SELECT max(o_orderdate) FROM orders) AS last "))
def stats_datetime(spark, sf):
    s = P.column_stats(table(spark, sf, "orders"), ["o_orderdate"])
    return s.select("column", "rows", "missing", "unique", "top", "top_count", "first", "last")


HIST_SQL = """
WITH s AS (SELECT min({v}) AS mn, max({v}) AS mx, (max({v}) - min({v})) / {k} AS step FROM {tab}),
e AS (SELECT i, CASE WHEN i = 0 THEN mn - (mx - mn) * 0.001 WHEN i = {k} THEN mx ELSE i * step + mn END AS e
      FROM s, range(0, {k} + 1) r(i)),
b AS (SELECT (SELECT count(*) FROM e WHERE e.i BETWEEN 1 AND {k} - 1 AND e.e < x.v) AS bucket
      FROM (SELECT {v} AS v FROM {tab} WHERE {v} IS NOT NULL) x),
c AS (SELECT bucket, count(*) AS n FROM b GROUP BY bucket)
SELECT CAST(l.i AS INTEGER) AS bucket, {left} AS "left", {right} AS "right", CAST(coalesce(c.n, 0) AS BIGINT) AS count
FROM e l JOIN e r ON r.i = l.i + 1 LEFT JOIN c ON c.bucket = l.i
"""


@query("hist_numeric", HIST_SQL.format(v="l_extendedprice", tab="lineitem", k=20,
                                       left="round(l.e, 4)", right="round(r.e, 4)"))
def hist_numeric(spark, sf):
    h = P.histogram(table(spark, sf, "lineitem"), "l_extendedprice", bins=20)
    return h.select("bucket", r4("left").alias("left"), r4("right").alias("right"), "count")


@query("hist_datetime", HIST_SQL.format(
    v="CAST(epoch_us(ts) AS DOUBLE)", tab="events", k=10,
    left="make_timestamp(CAST(floor(l.e) AS BIGINT))", right="make_timestamp(CAST(floor(r.e) AS BIGINT))"))
def hist_datetime(spark, sf):
    return P.histogram(table(spark, sf, "events"), "ts", bins=10)


@query("value_counts", """
SELECT c.v AS value, CAST(count(l_returnflag) AS BIGINT) AS count
FROM (VALUES ('A'), ('N'), ('R'), ('X')) c(v) LEFT JOIN lineitem ON l_returnflag = c.v GROUP BY c.v""")
def value_counts(spark, sf):
    li = ToCategorical(attributes={"l_returnflag": {"cat": ["A", "N", "R", "X"]}})(
        table(spark, sf, "lineitem").select("l_returnflag"))
    return P.value_counts(li, "l_returnflag")


@query("nan_counts", f"""
WITH t AS ({ORDERS_NULLS_SQL})
SELECT * FROM (SELECT 'o_orderkey' AS "column", count(*) - count(o_orderkey) AS missing FROM t
UNION ALL SELECT 'price', count(*) - count(price) FROM t
UNION ALL SELECT 'prio', count(*) - count(prio) FROM t
UNION ALL SELECT 'odate', count(*) - count(odate) FROM t
UNION ALL SELECT 'status', count(*) - count(status) FROM t)""")
def nan_counts(spark, sf):
    return P.missing_counts(orders_nulls(spark, sf))


@query("distinct_index", "SELECT DISTINCT o_custkey FROM orders")
def distinct_index(spark, sf):
    from ..operators.columns import SetIndex
    from ..table import Table
    t = SetIndex(columns=["o_custkey"])(Table(table(spark, sf, "orders")))
    return P.distinct_index_values(t)


@query("value_summary_events", """
SELECT "column", CAST(count(*) AS BIGINT) AS "unique", arg_min(value, (-n, value)) AS top,
       CAST(max(n) AS BIGINT) AS top_count
FROM (SELECT 'event_type' AS "column", event_type AS value, count(*) AS n FROM events GROUP BY 2
      UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*) FROM events GROUP BY 2)
GROUP BY 1""")
def value_summary_events(spark, sf):
    return P.value_summary(table(spark, sf, "events"), ["event_type", "user_id"]).select(
        "column", F.col("unique").cast("long").alias("unique"), "top", F.col("top_count").cast("long"))


HIST_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _hist_sql_col(c, k=20):
    body = HIST_SQL.format(v=c, tab="lineitem", k=k, left="round(l.e, 4)", right="round(r.e, 4)")
    return f"SELECT '{c}' AS \"column\", * FROM ({body})"


@query("hist_all_numeric", " UNION ALL ".join(_hist_sql_col(c) for c in HIST_COLS))
def hist_all_numeric(spark, sf):
    """A4 over several columns in two jobs (not two per column)."""
    h = P.histograms(table(spark, sf, "lineitem"), HIST_COLS, bins=20)
    return h.select("column", F.col("bucket").cast("int").alias("bucket"), r4("left").alias("left"),
                    r4("right").alias("right"), "count")


# long texts: only hashes are shuffled, the winners' texts are fetched afterwards
@query("stats_string_documents", """
WITH v AS (SELECT 'text' AS "column", text AS value FROM documents UNION ALL SELECT 'lang', lang FROM documents
           UNION ALL SELECT 'source', source FROM documents UNION ALL SELECT 'key', 'document ' || doc_id FROM documents),
c AS (SELECT "column", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL)
SELECT "column", count(*) AS "unique", max(n) AS top_count, md5(min(value) FILTER (n = m)) AS top
FROM (SELECT *, max(n) OVER (PARTITION BY "column") AS m FROM c) GROUP BY "column" """)
def stats_string_documents(spark, sf):
    d = table(spark, sf, "documents").select("text", "lang", "source", F.concat(F.lit("document "), "doc_id").alias("key"))
    return P.value_summary(d, d.columns).withColumn("top", F.md5(F.col("top").cast("binary")))
