"""Bucket expressions built from native column functions.

Three edge conventions exist in the engine and all are kept:
  * left-closed, last bucket closed (K-bins D1-D3): ``count(inner edges <= v)``
  * right-closed, minimum excluded (user ranges D4-D7): ``(a, b]``
  * right-closed, minimum included (histograms A4/A5)
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import qcol


def count_below(c: Column, edges: list, strict: bool = True, lo: int = 0, hi: int | None = None) -> Column:
    """Number of ``edges`` (sorted) that are ``< c`` (``<= c`` when not strict).

    A balanced CASE tree: O(log len(edges)) comparisons per row, stays in
    whole-stage codegen (no lambda over an array).
    """
    if hi is None:
        hi = len(edges)
    if lo >= hi:
        return F.lit(lo)
    mid = (lo + hi) // 2
    e = F.lit(edges[mid])
    go_left = (c <= e) if strict else (c < e)
    return F.when(go_left, count_below(c, edges, strict, lo, mid)).otherwise(
        count_below(c, edges, strict, mid + 1, hi))


#: Edges a CASE tree holds; more are searched by Spark's bucketizer.
TREE_EDGES = 128


def with_count_below(df: DataFrame, c: Column, edges: list, out: str, strict: bool = True) -> DataFrame:
    """``df`` with column ``out``: :func:`count_below` of ``c`` for any number of edges.

    Few edges make a CASE tree; many a binary search in the JVM over one sorted
    array (as double: equal doubles get equal counts), so the plan does not
    grow with the edges. Missing values give NULL.
    """
    if len(edges) <= TREE_EDGES:
        return df.withColumn(out, F.when(c.isNotNull(), count_below(c, edges, strict)))
    from pyspark.ml.feature import Bucketizer
    # buckets are closed on the left: for a strict count the edge is the next double up
    cuts = sorted({math.nextafter(float(e), math.inf) if strict else float(e) for e in edges})
    of = {e: i for i, e in enumerate(cuts)}
    if len(of) != len(edges):  # edges that are one double: the count steps over all of them at once
        return df.withColumn(out, F.when(c.isNotNull(), count_below(c, edges, strict)))
    key = "__bucket_of"
    bucketizer = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=key, outputCol=out, handleInvalid="keep")
    return bucketizer.transform(df.withColumn(key, c.cast("double"))).withColumn(out, qcol(out).cast("int")).drop(key)


def right_closed_label(c: Column, edges: list, labels: list) -> Column:
    """``labels[i]`` when ``edges[i] < c <= edges[i+1]``, NULL outside or missing."""
    expr = None
    for i, lab in enumerate(labels):
        cond = (c > F.lit(edges[i])) & (c <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(None).cast("string"))
