"""Positions of sorted rows and deep pages against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from tableprep.errors import OptionError
from tableprep.operators.convert import ToCategorical
from tableprep.operators.order import with_positions
from tableprep.sources import catalog
from tableprep.table import Table


def rows_of(seed, n=700):
    rng = random.Random(seed)
    return [(i, rng.choice([None, 5, 5, 5, rng.randint(-50, 50)]), rng.choice(["lo", "mid", "hi", None])) for i in range(n)]


def test_positions_follow_the_order(spark):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, "i int, v int, g string").repartition(5)
    df = ToCategorical(attributes={"g": {"cat": ["lo", "mid", "hi"], "ordered": True}})(df)
    got = sorted((r["position"], r["i"]) for r in with_positions(df, ["g", "v", "i"], [False, True, True]).collect())
    rank = {"lo": 0, "mid": 1, "hi": 2}
    want = sorted(rows, key=lambda r: (r[2] is None, -rank.get(r[2], 0), r[1] is None, r[1] or 0, r[0]))
    assert [i for _, i in got] == [r[0] for r in want] and [p for p, _ in got] == list(range(len(rows)))
    # a hot value is cut through: ties get positions too
    hot = spark.range(3000).select(F.lit(1).alias("x"), "id").repartition(6)
    assert sorted(r["position"] for r in with_positions(hot, "x").collect()) == list(range(3000))
    assert with_positions(df.limit(0), "v").count() == 0
    with pytest.raises(OptionError):
        with_positions(df, "v", name="g")
    assert isinstance(with_positions(Table(df), "v"), Table)


@pytest.mark.parametrize("kind", ["int", "double", "date", "string"])
def test_pages_at_any_depth(spark, monkeypatch, kind):
    monkeypatch.setattr(catalog, "RANGES", 9)
    monkeypatch.setattr(catalog, "ROWS_PER_RANGE", 60)
    value = {"int": "v", "double": "v / 7D", "date": "date_add(date'2020-01-01', v)", "string": "CASE WHEN v IS NOT NULL THEN format_string('%04d', v + 100) END"}[kind]
    rows = rows_of(2)
    df = spark.createDataFrame(rows, "i int, v int, g string").select("i", "v", F.expr(value).alias("k")).repartition(4)
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    for offset, n in ((0, 10), (3, 1), (120, 300), (137, 5), (350, 40), (690, 50), (700, 5), (5000, 3)):
        got = [r["i"] for r in catalog.head(df, n=n, offset=offset, order_by=["k", "i"], near=0).collect()]
        assert got == want[offset:offset + n], (offset, n)


def test_deep_page_sorts_its_ranges_only(spark):
    """Of 64 ranges one or two are left in the plan's filter."""
    df = spark.range(200_000).select(F.xxhash64("id").alias("k"))
    page = catalog.head(df, n=10, offset=150_000, order_by="k")
    want = [r["k"] for r in df.orderBy("k").offset(150_000).limit(10).collect()]
    assert [r["k"] for r in page.collect()] == want
    rows, offset = catalog._ranges_of_page(df, "k", 150_000, 10)
    assert rows.count() < 200_000 / 20 and 0 <= offset < rows.count()
