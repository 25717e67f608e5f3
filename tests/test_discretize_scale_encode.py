"""D1-D7, C1-C5 against plain-Python expectations on own rows and brute force."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableprep.errors import OptionError, SchemaError
from tableprep.ltypes import LType, categories, ltypes
from tableprep.operators.discretize import BinsDiscretizer, DateDiscretizer, RangeDiscretizer
from tableprep.operators.encode import CategoryCodes, EpochMillis, OneHotEncoder
from tableprep.operators.scale import MinMaxScaler, StandardScaler

from helpers import SF001, col


A = [12.0, -3.0, 0.5, 4.25, 27.0, 8.0]
B = [None, 2.0, 2.5, None, 8.0, 6.1]


@pytest.fixture
def nums(spark):
    return spark.createDataFrame(list(zip(range(6), A, B)), "i int, a double, b double")


def uniform(values, k):
    """Bin of each value among k equal bins of the range, as a category name."""
    known = [v for v in values if v is not None]
    edges = np.linspace(min(known), max(known), k + 1)[1:-1]
    return [None if v is None else f"{int((edges <= v).sum())}.0" for v in values]


def test_bins_uniform_in_place(nums):
    out = BinsDiscretizer(attributes={"a": {"bins": 4}, "b": {"bins": 3}}, strategy="uniform")(nums)
    assert col(out, "a") == uniform(A, 4) and col(out, "b") == uniform(B, 3)
    assert ltypes(out)["b"] == LType.ORDINAL and categories(out, "b") == ["0.0", "1.0", "2.0"]


def test_bins_suffix_replaces_existing(nums):
    df = nums.withColumn("b_cut", F.lit("old"))
    out = BinsDiscretizer(attributes={"a": {"bins": 4}, "b": {"bins": 3}}, suffix="_cut")(df)
    assert out.columns == ["i", "a", "b", "b_cut", "a_cut"]
    assert col(out, "b_cut") == uniform(B, 3)


def test_bins_values_on_edges(spark):
    """Tenths: each value is in the bin it begins, whatever the rounding of the edges; all bins are categories."""
    df = spark.createDataFrame([(j, j / 10) for j in range(11)], "i int, x double")
    out = BinsDiscretizer(attributes={"x": {"bins": 10}})(df)
    assert col(out, "x") == [f"{min(j, 9)}.0" for j in range(11)]
    flat = spark.createDataFrame([(j, 1.0 if j < 90 else 2.0) for j in range(100)], "i int, x double")
    q = BinsDiscretizer(attributes={"x": {"bins": 5}}, strategy="quantile")(flat)
    assert categories(q, "x") == [f"{j}.0" for j in range(5)]


def test_bins_option_errors():
    with pytest.raises(OptionError) as e:
        BinsDiscretizer(attributes={})
    assert "no_columns" in e.value.codes
    with pytest.raises(OptionError) as e:
        BinsDiscretizer(attributes={"a": {"bins": None}})
    assert "not_given" in e.value.codes


def test_bins_quantile_brute_force(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_extendedprice")
    m = BinsDiscretizer(attributes={"l_extendedprice": {"bins": 4}}, strategy="quantile", suffix="_q").fit(li)
    v = np.array([r[0] for r in li.select("l_extendedprice").collect()])
    ref = np.percentile(v, [0, 25, 50, 75, 100])
    assert np.allclose(m.params["edges"]["l_extendedprice"], ref, rtol=0, atol=1e-9)
    out = m.transform(li)
    counts = {r[0]: r[1] for r in out.groupBy("l_extendedprice_q").count().collect()}
    assert sum(counts.values()) == len(v) and set(counts) == {"0.0", "1.0", "2.0", "3.0"}


def test_bins_kmeans_separates_clusters(spark):
    rows = [(i, float(v)) for i, v in enumerate([1, 1.2, 0.9, 1.1, 10, 10.5, 9.8, 20, 21, 19.5])]
    df = spark.createDataFrame(rows, "i int, x double")
    out = BinsDiscretizer(attributes={"x": {"bins": 3}}, strategy="kmeans")(df)
    assert col(out, "x") == ["0.0"] * 4 + ["1.0"] * 3 + ["2.0"] * 3


def test_bins_constant_and_all_missing(spark):
    df = spark.createDataFrame([(0, 5.0, None), (1, 5.0, None)], "i int, c double, m double")
    out = BinsDiscretizer(attributes={"c": {"bins": 3}, "m": {"bins": 2}}, strategy="quantile")(df)
    assert col(out, "c") == ["0.0", "0.0"] and col(out, "m") == [None, None]


def test_range_discretizer(nums):
    cuts, names = [-3, 1, 5, 20], ["low", "mid", "high"]
    out = RangeDiscretizer(table={"a": {"bins": cuts, "labels": names}})(nums)
    want = [next((n for lo, hi, n in zip(cuts, cuts[1:], names) if lo < v <= hi), None) for v in A]
    assert col(out, "a_bins") == want and categories(out, "a_bins") == names



@pytest.fixture
def dates(spark):
    return spark.createDataFrame(
        [(0, datetime(1988, 5, 9), datetime(1950, 1, 1)), (1, datetime(1994, 12, 22), datetime(1980, 12, 22)),
         (2, datetime(1995, 11, 21), datetime(1995, 11, 21)), (3, None, None),
         (4, datetime(2012, 12, 12), datetime(2034, 12, 12))], "i int, cold timestamp_ntz, cold2 timestamp_ntz")


def test_date_ranges_by_date(dates):
    edges = ["1950-01-01", "1970-01-01", "1990-01-01", "2010-01-01", "2030-01-01"]
    labs = ["50", "70", "80", "now"]
    out = DateDiscretizer(selected={"cold": {"ranges": (edges, True, False), "labels": labs},
                                    "cold2": {"ranges": (edges, True, True), "labels": labs}}, suffix="_disc")(dates)
    assert col(out, "cold_disc") == ["70", "80", "80", None, "now"]
    assert col(out, "cold2_disc") == [None, "70", "80", None, None]


def test_time_ranges(spark):
    d = datetime(2020, 3, 4)
    t = lambda h, m, s=0: d.replace(hour=h, minute=m, second=s)
    df = spark.createDataFrame(
        [(0, t(10, 42), t(22, 59)), (1, t(23, 59, 7), t(12, 0)), (2, t(7, 12), t(16, 40, 2)),
         (3, None, t(16, 40, 3)), (4, t(18, 13), t(22, 0, 2))], "i int, cold timestamp_ntz, cold2 timestamp_ntz")
    edges = ["00:00", "06:00", "12:00", "16:40:02", "22:00", "23:59"]
    labs = ["night1", "morning", "afternoon", "evening", "night2"]
    out = DateDiscretizer(selected={c: {"ranges": (edges, False, True), "labels": labs} for c in ["cold", "cold2"]})(df)
    assert col(out, "cold_discr") == ["morning", None, "morning", None, "evening"]
    assert col(out, "cold2_discr") == ["night2", "morning", "afternoon", "evening", "night2"]


def test_date_option_errors():
    with pytest.raises(OptionError) as e:
        DateDiscretizer(selected={"c": {"ranges": (["2000-01-01", "1999-01-01"], True, False), "labels": ["a", "b"]}},
                        suffix="")
    assert {"bins", "len", "empty_suffix"} <= set(e.value.codes)
    with pytest.raises(OptionError) as e:
        DateDiscretizer(selected={"c": {"ranges": (["2000-01-01", "2001-01-01", "2002-01-01"], True, False),
                                        "labels": ["a", "a"]}})
    assert "unique" in e.value.codes


@pytest.fixture
def scale(spark):
    return spark.createDataFrame(
        [(0, 5.0, 2.0), (1, -7.5, 3.5), (2, 0.5, None), (3, 9.0, 11.0), (4, 2.0, None)], "i int, col1 double, col2 double")


def test_minmax(scale):
    out = MinMaxScaler(attributes={"col1": {"range": (-1, 1)}, "col2": {"range": (2, 4)}})(scale)
    v = np.array([5, -7.5, 0.5, 9, 2])
    exp = (v - v.min()) / (v.max() - v.min()) * 2 - 1
    assert np.allclose(col(out, "col1"), exp)
    c2 = col(out, "col2")
    assert c2[2] is None and c2[4] is None and np.allclose([c2[0], c2[1], c2[3]], [2, 2 + 2 * 1.5 / 9, 4])
    with pytest.raises(OptionError):
        MinMaxScaler(attributes={"col1": {"range": (1, 1)}})


def test_standard(spark, scale):
    out = StandardScaler(attributes=["col1", "col2"])(scale)
    v = np.array([5, -7.5, 0.5, 9, 2])
    assert np.allclose(col(out, "col1"), (v - v.mean()) / v.std())
    allmiss = spark.createDataFrame([(0, None), (1, None)], "i int, c double")
    assert col(StandardScaler(attributes=["c"])(allmiss), "c") == [None, None]
    const = spark.createDataFrame([(0, 2.0), (1, 2.0)], "i int, c double")
    assert col(StandardScaler(attributes=["c"])(const), "c") == [0.0, 0.0]
    assert col(MinMaxScaler(attributes={"c": {"range": (3, 4)}})(const), "c") == [3.0, 3.0]


def test_onehot(spark):
    df = spark.createDataFrame([(0, "3", "q", 9), (1, "4", "2", 9), (2, "5", "q", 9), (3, "6", "q", 9), (4, "0", "2", 9)],
                               "i int, col2 string, col3 string, col3_q int")
    out = OneHotEncoder(attributes=["col3", "col2"], include_nan=True)(df)
    assert out.columns == ["i", "col2", "col3", "col3_q", "col3_2", "col3_nan",
                           "col2_0", "col2_3", "col2_4", "col2_5", "col2_6", "col2_nan"]
    assert col(out, "col3_q") == [1, 0, 1, 1, 0] and col(out, "col2_nan") == [0] * 5
    assert ltypes(out)["col3_q"] == LType.NOMINAL


def test_onehot_category_cap(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(5)], "i int, c string")
    with pytest.raises(SchemaError):
        OneHotEncoder(attributes=["c"], max_categories=4)(df)
    out = OneHotEncoder(attributes=["c"], max_categories=5)(df)
    assert out.columns == ["i", "c"] + [f"c_{i}" for i in range(5)]


def test_codes_and_epoch(spark):
    md = {"ltype": "ordinal", "categories": ["b", "a"]}
    df = spark.createDataFrame([(0, "a", datetime(1970, 1, 1, 0, 0, 1, 500)), (1, "b", None), (2, "z", None)],
                               "i int, c string, t timestamp_ntz")
    df = df.select("i", F.col("c").alias("c", metadata=md), "t")
    out = CategoryCodes(attributes=["c"])(df)
    assert col(out, "c") == [1, 0, None]
    assert col(EpochMillis(attributes=["t"])(df), "t") == [1000.5, None, None]
    with pytest.raises(SchemaError):
        CategoryCodes(attributes=["t"])(df)


def _lloyd_edges(v, k):
    lo, hi = v.min(), v.max()
    u = np.linspace(lo, hi, k + 1)
    cen = (u[1:] + u[:-1]) * 0.5
    for _ in range(300):
        mids = (cen[1:] + cen[:-1]) * 0.5
        idx = np.searchsorted(mids, v, side="left")
        new = np.sort(np.array([v[idx == j].mean() if (idx == j).any() else cen[j] for j in range(k)]))
        if np.array_equal(new, cen):
            break
        cen = new
    return [lo] + list((cen[1:] + cen[:-1]) * 0.5) + [hi]


def test_bins_kmeans_query_brute_force(spark):
    """The registered k-means query (no SQL oracle) against numpy Lloyd on the whole column."""
    import __spark_entry__ as E
    out = E.queries()["bins_kmeans"](spark, SF001)
    pdf = out.toPandas()
    v = pdf["l_quantity"].to_numpy(dtype=float)
    edges = _lloyd_edges(np.sort(v), 3)
    expect = np.minimum(np.searchsorted(edges[1:-1], v, side="right"), 2)
    assert list(pdf["l_quantity_km"]) == [repr(float(x)) for x in expect]
    m = BinsDiscretizer(attributes={"l_extendedprice": {"bins": 4}}, strategy="kmeans").fit(
        spark.read.parquet(f"{SF001}/lineitem.parquet"))
    ev = np.sort(spark.read.parquet(f"{SF001}/lineitem.parquet").select("l_extendedprice").toPandas()
                 ["l_extendedprice"].to_numpy(dtype=float))
    assert np.allclose(m.params["edges"]["l_extendedprice"], _lloyd_edges(ev, 4), rtol=1e-9)
