"""Connected components of a graph held in a DataFrame, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts_for, stored

MAX_ROUNDS = 60
EDGES_PER_FILE = 200_000


def components(edges: DataFrame, parts: int | None = None, *, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``(a, b)`` long -> ``(node, root)``: the smallest node that each node of an edge can reach.

    Large-star and small-star steps in turn, each a grouping whose groups are
    only reduced to their minimum, so a star of any size is never gathered.
    ``parts``: files of the first edge list, if known to be few.
    The number of rounds grows with the logarithm of the largest component;
    the edge list is stored between rounds. Fails if it has not settled.
    """
    cur = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), parts)
    parts, last = parts_for(cur.count(), EDGES_PER_FILE), None  # a round leaves no more edges than it finds
    for _ in range(max_rounds):
        # large star: neighbours above a node go to the node's smallest neighbour (or itself)
        both = cur.select("v", "u").unionByName(cur.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m"))
        low = low.select("v", F.least("v", "m").alias("m"))
        large = both.join(low, "v").filter("u > v and u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = large.distinct()
        # small star: a node and its lower neighbours go to the smallest of them
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        down = large.join(low, "v")
        small = down.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(
            low.select("v", F.col("m").alias("u")))
        cur = stored(small.distinct(), parts)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == last:
            # settled: every node points at its root, which points nowhere
            return cur.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(
                cur.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        last = now
    raise RuntimeError(f"components have not settled after {max_rounds} rounds")
