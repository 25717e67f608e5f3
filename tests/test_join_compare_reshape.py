"""J1-J9, U2-U4, X1, V1, V2."""

import pytest
from pyspark.sql import functions as F

from tableprep.errors import OptionError
from tableprep.ltypes import LType, ltypes
from tableprep.operators.chartdata import scatter_data, series_data, value_range
from tableprep.operators.columns import SetIndex
from tableprep.operators.compare import RemoveDuplicateColumns, table_diff, table_equal
from tableprep.operators.join import Join, bounded_broadcast
from tableprep.operators.reshape import extract_series
from tableprep.table import Table

SIZES = {"ltype": "ordinal", "categories": ["small", "medium", "large"]}
PARCELS = [(f"p{i}", ["small", "large", "medium", None][i % 4], i * 1.5, "north" if i % 3 else "south") for i in range(9)]
TARIFFS = [("large", 9, "fast"), ("medium", 5, "slow"), ("huge", 20, "slow")]


@pytest.fixture
def parcels_tariffs(spark):
    """Parcels by size; tariffs by size, one of which no parcel has. Both have a column ``way``."""
    parcels = spark.createDataFrame([(*r, f"w{r[0]}") for r in PARCELS], "parcel string, size string, weight double, depot string, way string")
    tariffs = spark.createDataFrame(TARIFFS, "size string, price long, way string")
    return parcels, tariffs.select(F.col("size").alias("size", metadata=SIZES), "price", "way")


def test_join_on_indexes_of_two_names(parcels_tariffs):
    """Index levels of different names: joined by value, the name is lost, clashing columns get the suffixes."""
    parcels, tariffs = parcels_tariffs
    left = SetIndex(columns=["size"])(Table(parcels))
    right = SetIndex(columns=["kind"])(Table(tariffs.withColumnRenamed("size", "kind")))
    out = Join(on="index", how="inner", suffixes=("_mine", "_theirs"))(left, right)
    assert out.index == ("index",)
    assert sorted(out.columns) == ["depot", "parcel", "price", "way_mine", "way_theirs", "weight"]
    price = {size: p for size, p, _ in TARIFFS}
    got = {(r["__ix__index"], r["parcel"], r["price"]) for r in out.df.collect()}
    assert got == {(size, p, price[size]) for p, size, _, _ in PARCELS if size in price}


def test_join_on_levels_in_common(parcels_tariffs):
    parcels, tariffs = parcels_tariffs
    left = SetIndex(columns=["depot", "size"])(Table(parcels.select("depot", "size", "parcel", "way")))
    right = SetIndex(columns=["size", "price"])(Table(tariffs))
    out = Join(on="index", how="outer", suffixes=("_mine", "_theirs"))(left, right)
    assert out.index == ("size", "depot", "price")
    assert sorted(out.columns) == ["parcel", "way_mine", "way_theirs"]
    rows = {(r["__ix__size"], r["__ix__depot"], r["__ix__price"], r["parcel"]) for r in out.df.collect()}
    price = {size: p for size, p, _ in TARIFFS}
    assert rows == {(size, d, price.get(size), p) for p, size, _, d in PARCELS} | {("huge", None, 20, None)}


def test_join_of_number_and_category_is_an_error(parcels_tariffs):
    parcels, tariffs = parcels_tariffs
    with pytest.raises(OptionError) as e:
        Join(on="index", how="left")(SetIndex(columns=["weight"])(Table(parcels)), SetIndex(columns=["size"])(Table(tariffs)))
    assert e.value.codes == ["type"]
    with pytest.raises(OptionError) as e:
        Join(left_on="weight", right_on="size", how="left")(parcels, tariffs)
    assert e.value.codes == ["type"]


def test_join_null_keys_match_and_merge(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n1"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "A"), (None, "N"), (4, "D")], "k int, x string")
    out = Join(left_on="k", right_on="k", how="outer")(a, b)
    assert out.columns == ["k", "x_l", "x_r"]
    got = {(r.k, r.x_l, r.x_r) for r in out.collect()}
    assert got == {(1, "a", "A"), (None, "n1", "N"), (3, "c", None), (4, None, "D")}


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_skew_split_equals_plain_join(spark, how):
    a = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.lit(None))
                                 .otherwise(F.col("id")).alias("k"), F.col("id").alias("a"))
    b = spark.createDataFrame([(7, "x"), (None, "n"), (5, "y"), (8, "z"), (7, "x2")], "k long, b string")
    plain = Join(left_on="k", right_on="k", how=how)(a, b)
    split = Join(left_on="k", right_on="k", how=how, skew="auto", skew_min_rows=100, salt_buckets=8)(a, b)
    assert split.count() == plain.count()
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    hot_absent = Join(left_on="k", right_on="k", how=how, skew=[2])(a, b)  # explicit key, no partner
    assert hot_absent.exceptAll(plain).count() == 0 and plain.exceptAll(hot_absent).count() == 0


def test_join_broadcast_only_when_small(spark):
    small = spark.range(10)
    big = spark.range(1000)
    assert "ResolvedHint" in bounded_broadcast(small, 100)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" not in bounded_broadcast(big, 100)._jdf.queryExecution().analyzed().toString()


def test_remove_duplicate_columns(spark):
    df = spark.createDataFrame([(1.0, 3.0, "q", "q", "a"), (2.0, 4.0, "2", "2", "b"), (3.0, None, "c", "c", "c"),
                                (None, 6.0, "4", "4", "d"), (10.0, None, None, None, "e")],
                               "col1 double, col2 double, col3 string, col11 string, date string")
    m = RemoveDuplicateColumns(attributes=["col1", "col2", "col3", "col11"]).fit(df)
    assert m.params["dropped"] == ["col11"]
    # same multiset, different rows: not equal
    perm = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert RemoveDuplicateColumns(attributes=["a", "b"]).fit(perm).params["dropped"] == []


def test_equal_and_diff(spark):
    a = spark.createDataFrame([(1, "x", 1.5), (2, "y", None), (3, "z", 3.0)], "k int, s string, v double")
    b = spark.createDataFrame([(3, "z", 3.0), (1, "x", 1.5), (2, "y", None)], "k int, s string, v double")
    c = spark.createDataFrame([(1, "x", 1.5), (2, "Y", None), (4, "w", 4.0)], "k int, s string, v double")
    assert table_equal(a, b).collect()[0]["equal"] is True
    assert table_equal(a, c).collect()[0]["equal"] is False
    d = sorted(tuple(r) for r in table_diff(a, c, "k").collect())
    assert d == [(2, "s", "y", "Y"), (3, "s", "z", None), (3, "v", "3.0", None), (4, "s", None, "w"),
                 (4, "v", None, "4.0")]


@pytest.fixture
def waves(spark):
    f = spark.createDataFrame([("hiab", 2.3, 3.0, "cat1"), ("gine", 3.4, 4.0, "cat2"), ("hiac", 10.2, None, "ww"),
                               ("hiaa", 14.6, 6.0, "1"), ("hiad", 66.3, None, "10")],
                              "id string, diab1 double, diab2 double, new1 string")
    g = spark.createDataFrame([("hiab", 12.0, 1.0, 0.0), ("hiae", None, -12.0, 0.0), ("hiac", 21.2, 2.3, 1.0),
                               ("hiaa", 13.45, 4.1, 0.0), ("hiad", 1.02, 5.6, 0.0)],
                              "id string, diab4 double, diab3 double, newt double")
    return SetIndex(columns=["id"])(Table(f)), SetIndex(columns=["id"])(Table(g))


def test_extract_series(waves):
    f, g = waves
    series = {"diab": [("G", "diab4", "wave4"), ("F", "diab2", "wave2"), ("F", "diab1", "wave1"), ("G", "diab3", "wave3")],
              "other": [("F", "new1", "wave1"), ("F", "diab2", "wave2"), ("G", "newt", "wave3"), ("F", "diab1", "wave4")]}
    out = extract_series({"F": f, "G": g}, series, ["wave1", "wave2", "wave3", "wave4"])
    df = out.to_df()
    assert df.count() == 24 and out.index == ("id", "time")
    assert ltypes(df)["time"] == LType.ORDINAL
    got = {(r.id, r.time): (r.diab, r.other) for r in df.collect()}
    assert [got[("hiac", w)][0] for w in ["wave1", "wave2", "wave3", "wave4"]] == [10.2, None, 2.3, 21.2]
    assert [got[("hiac", w)][1] for w in ["wave1", "wave2", "wave3", "wave4"]] == ["ww", None, "1.0", "10.2"]
    assert [got[("gine", w)][0] for w in ["wave1", "wave2", "wave3", "wave4"]] == [3.4, 4.0, None, None]
    assert [got[("hiae", w)][0] for w in ["wave1", "wave2", "wave3", "wave4"]] == [None, None, -12.0, None]


def test_extract_series_errors(spark, waves):
    f, g = waves
    with pytest.raises(OptionError) as e:
        extract_series({"F": f}, {"s": [("F", "diab1", "a"), ("F", "diab2", "a")]}, ["a", "b"])
    assert {"duplicates", "length"} <= set(e.value.codes)
    with pytest.raises(OptionError) as e:
        extract_series({"F": f}, {"s": [("F", "diab1", "a")]}, ["a", "a"])
    assert "duplicates" in e.value.codes
    with pytest.raises(OptionError) as e:
        extract_series({"F": f}, {}, [])
    assert {"no_series", "no_labels"} <= set(e.value.codes)
    with pytest.raises(OptionError) as e:
        extract_series({"F": f}, {"": [("F", "diab1", "a")]}, ["a"])
    assert "empty_name" in e.value.codes
    dup = SetIndex(columns=["id"])(Table(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "id string, v double")))
    with pytest.raises(Exception):
        extract_series({"F": f, "D": dup}, {"s": [("F", "diab1", "x"), ("D", "v", "y")]}, ["x", "y"]).df.collect()


def test_chart_data(spark):
    from datetime import datetime
    md = {"ltype": "nominal", "categories": ["a", "b"]}
    df = spark.createDataFrame([(1.0, 2.0, "a", datetime(1970, 1, 1)), (None, 3.0, "b", datetime(1970, 1, 2)),
                                (4.0, 5.0, "b", None)], "x double, y double, k string, t timestamp_ntz")
    df = df.select("x", "y", F.col("k").alias("k", metadata=md), "t")
    sc = scatter_data(df, ["x", "y", "k"])
    assert sorted(tuple(r) for r in sc.collect()) == [(1.0, 2.0, 0.0), (4.0, 5.0, 1.0)]
    s = series_data(df, "t", ["x", "y"])
    assert s.count() == 4
    r = value_range(s).collect()[0]
    assert (r["min"], r["max"]) == (1.0, 3.0)
