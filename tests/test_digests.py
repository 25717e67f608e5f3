"""U2, U3 by digests; A2 by hashes first and texts last."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tableprep.operators import compare
from tableprep.operators.compare import table_diff, table_equal
from tableprep.operators.profile import value_summary


def eq(a, b):
    return table_equal(a, b).collect()[0]["equal"]


def test_equal_tells_nulls_places_and_repeats_apart(spark):
    kind = "a string, b string"
    make = lambda rows: spark.createDataFrame(rows, kind).repartition(3)
    assert eq(make([("x", None), ("y", "z")]), make([("y", "z"), ("x", None)]))
    assert not eq(make([("x", None)]), make([(None, "x")]))
    assert not eq(make([("ab", "c")]), make([("a", "bc")]))
    assert not eq(make([("a", "a"), ("a", "a"), ("b", "b")]), make([("a", "a"), ("b", "b"), ("b", "b")]))
    assert not eq(make([(None, None)]), make([]))
    assert eq(make([]), make([])) and eq(make([(None, None)] * 5), make([(None, None)] * 5))
    # numbers of different widths with the same values
    assert eq(spark.range(5).select(F.col("id").cast("int").alias("i")), spark.range(5).select(F.col("id").alias("i")))
    assert eq(spark.createDataFrame([(0.0,)], "x double"), spark.createDataFrame([(-0.0,)], "x double"))


def exchanged(df):
    """Columns that the plan's exchanges move."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if re.search(r"\bExchange\b", x)]


def test_equal_moves_no_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = table_equal(d, d.select(*reversed(d.columns)))
    assert out.collect()[0]["equal"]
    assert all("SinglePartition" in x for x in exchanged(out))  # the tasks' sums only


@pytest.mark.parametrize("seed", range(3))
def test_diff_against_plain_python(spark, monkeypatch, seed):
    monkeypatch.setattr(compare, "RANGES", 7)
    monkeypatch.setattr(compare, "FINE", 50)
    rng = random.Random(seed)
    value = lambda: rng.choice([None, "", "x", "y" * 50])
    left = {i: (value(), value()) for i in [None, *range(120)]}
    right = {k: (v if rng.random() < 0.9 else (v[0], value())) for k, v in left.items() if rng.random() < 0.97}
    right |= {1000 + i: (value(), None) for i in range(rng.randint(0, 4))}
    make = lambda d: spark.createDataFrame([(k, *v) for k, v in d.items()], "k int, a string, b string").repartition(4)
    want = []
    for k in set(left) | set(right):
        for i, c in enumerate("ab"):
            lv, rv = (d[k][i] if k in d else None for d in (left, right))
            if k not in left or k not in right or lv != rv:
                want.append((k, c, lv, rv))
    got = [tuple(r) for r in table_diff(make(left), make(right), "k").collect()]
    assert Counter(got) == Counter(want)
    assert table_diff(make(left), make(left), "k").count() == 0


def test_diff_with_repeated_keys_pairs_all_rows(spark):
    a = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    got = sorted(tuple(r) for r in table_diff(a, a, "k").collect())
    assert got == [(1, "v", "x", "y"), (1, "v", "y", "x")]


def test_summary_fetches_texts_last(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["b", "a", "c" * 5000, None]), f"u{i}", None, "only") for i in range(900)] + [("a" * 9000, "u0", None, "only")] * 3
    df = spark.createDataFrame(rows, "tied string, mostly string, none string, one string").repartition(4)
    got = {r["column"]: tuple(r)[1:] for r in value_summary(df, df.columns).collect()}
    for i, c in enumerate(df.columns):
        counts = Counter(r[i] for r in rows if r[i] is not None)
        if counts:
            top = max(counts.values())
            assert got[c] == (len(counts), min(k for k, n in counts.items() if n == top), top)
    assert "none" not in got
    assert value_summary(df.limit(0), df.columns).count() == 0
