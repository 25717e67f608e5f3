"""Hot keys of full outer joins are found without being asked for."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableprep.operators import join as J
from tableprep.operators.join import Join, found_hot_keys


@pytest.fixture
def many_partitions(spark):
    names = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}  # as for sides too large to broadcast
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def sides(spark, n=240_000, null_too=False):
    """30 % of the left rows (and as many again of nulls) have one key."""
    hot = F.when(F.col("id") % 10 < 3, F.lit(7))
    if null_too:
        hot = hot.when(F.col("id") % 10 < 5, F.lit(None).cast("int"))
    left = spark.range(n).select(hot.otherwise((F.col("id") % 20_011).cast("int")).alias("k"), F.col("id").alias("a"), F.sha2(F.col("id").cast("string"), 256).alias("fat"))
    right = spark.range(15_000).select((F.col("id") * 2).cast("int").alias("k"), F.col("id").alias("b"))
    return left, right.unionByName(spark.createDataFrame([(7, -1), (None, -2)], "k int, b long"))


@pytest.mark.parametrize("null_too", [False, True])
def test_default_outer_join_spreads_hot_keys(spark, many_partitions, null_too):
    left, right = sides(spark, null_too=null_too)
    out = Join(left_on="k", right_on="k", how="outer")(left, right)
    per_task = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
    assert per_task[-1] <= 3 * per_task[len(per_task) // 2], per_task
    want = Join(left_on="k", right_on="k", how="outer", skew=None)(left, right)
    assert sorted(out.columns) == sorted(want.columns)
    cols = sorted(want.columns)
    assert out.select(cols).exceptAll(want.select(cols)).isEmpty() and want.select(cols).exceptAll(out.select(cols)).isEmpty()
    plain = sorted(r["count"] for r in want.groupBy(F.spark_partition_id()).count().collect())
    assert plain[-1] > 3 * plain[len(plain) // 2]  # what it would have been


def test_found_keys_are_counted_exactly(spark, many_partitions):
    left, right = sides(spark, null_too=True)
    hot, average = found_hot_keys(left, right, ["k"], ["k"])
    counts = Counter(r["k"] for r in left.select("k").collect())
    assert sorted(hot, key=str) == sorted([((7,), counts[7], 1), ((None,), counts[None], 1)], key=str)
    assert average == (240_000 + 15_002) // 24
    even = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("fat"))
    assert found_hot_keys(even, even, ["k"], ["k"])[0] == []


def test_small_sides_are_joined_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(J, "_hot_keys", lambda *a: pytest.fail("looked for hot keys"))
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    assert Join(left_on="k", right_on="k", how="outer")(a, a).count() == 5
