"""N1, N2, W1, W2, T1-T5, R1, R2 against plain-Python expectations on own rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tableprep.errors import OptionError
from tableprep.ltypes import LType, categories, ltypes
from tableprep.operators.convert import ToCategorical, ToNumeric, ToString, ToTimestamp
from tableprep.operators.fill import FillNan, directional_fill
from tableprep.operators.replace import ReplaceValues

from helpers import SF001, col

GRADES = ["poor", "fair", "fine"]
ROWS = [(i, None if i % 4 == 1 else 1.5 * i - 4, GRADES[i % 3] if i % 5 < 3 else None, f"note {i}" if i % 3 else None,
         None if i in (2, 3, 9) else datetime(2001 + i, 1 + i % 12, 3, 4, 5, 6)) for i in range(11)]


@pytest.fixture
def fill(spark):
    df = spark.createDataFrame(ROWS, "i int, qty double, grade string, note string, day timestamp_ntz")
    return df.select("i", "qty", F.col("grade").alias("grade", metadata={"ltype": "ordinal", "categories": GRADES}),
                     "note", "day")


def carried(values, forward=True):
    out, last = [], None
    for v in values if forward else reversed(values):
        last = v if v is not None else last
        out.append(last)
    return out if forward else out[::-1]


def columns(*at):
    return [[r[k] for r in ROWS] for k in at]


def test_fill_mean(fill):
    out = FillNan(method="mean", selected=["qty", "day"])(fill)
    qty, day = columns(1, 4)
    known = [v for v in qty if v is not None]
    assert col(out, "qty") == pytest.approx([sum(known) / len(known) if v is None else v for v in qty])
    zero = datetime(1970, 1, 1)
    secs = [(d - zero).total_seconds() for d in day if d is not None]
    assert abs((col(out, "day")[2] - zero).total_seconds() - sum(secs) / len(secs)) < 1e-3


@pytest.mark.parametrize("method", ["ffill", "bfill"])
def test_directional(fill, method):
    out = FillNan(method=method, selected=["qty", "grade", "note", "day"], order_by="i")(fill)
    for name, values in zip(("qty", "grade", "note", "day"), columns(1, 2, 3, 4)):
        assert col(out, name) == carried(values, method == "ffill")
    assert categories(out, "grade") == GRADES  # category metadata kept


def test_missing_order_key_comes_first(spark):
    rows = [(None, 9.0, "a"), (1, None, None), (2, 5.0, None), (3, None, "b"), (4, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "k int, v double, t string")
    for cols in (["v"], ["t"], ["v", "t"]):
        for ranges in (None, 3):
            out = FillNan(method="ffill", selected=cols, order_by="k", ranges=ranges)(df)
            got = {r["k"]: r for r in out.collect()}
            for c in cols:
                want = carried([r[{"v": 1, "t": 2}[c]] for r in rows])
                assert [got[k][c] for k, *_ in rows] == want


def test_many_ranges_build_quickly(spark):
    """Tens of thousands of edges: the plan does not grow with them."""
    from tableprep.functions.buckets import with_count_below
    df = spark.range(0, 200_000, 1, 4).select(F.col("id"), (F.col("id") * 3 % 200_000).alias("k"))
    edges = list(range(0, 196_608, 3))
    out = with_count_below(df, F.col("k"), edges, "b")
    assert out.where(F.col("b") != F.least(F.ceil(F.col("k") / 3), F.lit(len(edges)))).count() == 0
    loose = with_count_below(df, F.col("k"), edges, "b", strict=False)
    assert loose.where(F.col("b") != F.least(F.floor(F.col("k") / 3) + 1, F.lit(len(edges)))).count() == 0
    missing = with_count_below(spark.range(1).select(F.lit(None).cast("long").alias("k")), F.col("k"), edges, "b")
    assert missing.first()["b"] is None


def test_fill_value(fill):
    out = FillNan(method="value", selected={"qty": -2.5, "day": "1999-12-31 23:59:58"})(fill)
    qty, day = columns(1, 4)
    assert col(out, "qty") == [-2.5 if v is None else v for v in qty]
    assert col(out, "day") == [datetime(1999, 12, 31, 23, 59, 58) if v is None else v for v in day]
    with pytest.raises(Exception):
        FillNan(method="value", selected={"note": "x"})(fill)  # text is not accepted


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("ranges,part,per_range", [(3, (), None), (7, ("user_id",), None), (64, (), None),
                                                   (None, ("user_id",), 700)])
def test_range_carry_equals_plain_window(spark, forward, ranges, part, per_range):
    """Carry scheme == one plain window, with null runs longer than a range."""
    e = spark.read.parquet(f"{SF001}/events.parquet")
    e = e.select("event_id", "user_id",
                 F.when((F.col("event_id") > 100) & (F.col("event_id") < 4000), None).otherwise(F.col("value")).alias("v"),
                 F.when(F.col("value") < 200, None).otherwise(F.col("event_type")).alias("t"))
    got = directional_fill(e, ["v", "t"], "event_id", part, forward=forward, ranges=ranges,
                           rows_per_range=per_range or 2_000_000)
    from pyspark.sql import Window
    w = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(1))
    w = w.orderBy("event_id")
    w = w.rowsBetween(Window.unboundedPreceding, 0) if forward else w.rowsBetween(0, Window.unboundedFollowing)
    fn = (lambda c: F.last(c, True)) if forward else (lambda c: F.first(c, True))
    ref = e.select("event_id", "user_id", fn("v").over(w).alias("v"), fn("t").over(w).alias("t"))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_range_carry_fine_grid(spark):
    """More ranges than the first quantile grid (the finer-grid path)."""
    test_range_carry_equals_plain_window(spark, True, None, (), 8)


def test_to_numeric(spark):
    texts = [" 17 ", None, "-2.5e3", "Infinity", "-inf", ".5", "7."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    want = [None if x is None else float(x) for x in texts]
    for errors in ("coerce", "raise"):
        assert col(ToNumeric(attributes=["t"], errors=errors)(df), "t") == want
    bad = spark.createDataFrame([(0, "12 apples")], "i int, t string")
    assert col(ToNumeric(attributes=["t"], errors="coerce")(bad), "t") == [None]
    with pytest.raises(Exception):
        ToNumeric(attributes=["t"], errors="raise")(bad).collect()


def test_to_categorical(spark):
    sizes = ["XL", "S", None, "M", "S", "giant"]
    nums = [2.0, 0.25, 2.0, None, 11.0, -1.0]
    df = spark.createDataFrame(list(zip(range(6), sizes, nums)), "i int, size string, n double")
    order = ["S", "M", "L", "XL"]
    out = ToCategorical(attributes={"size": {"cat": order, "ordered": True}})(df)
    assert col(out, "size") == [v if v in order else None for v in sizes]
    assert ltypes(out)["size"] == LType.ORDINAL and categories(out, "size") == order
    back = ToCategorical(attributes={"size": {"ordered": False}})(out)  # Ordinal -> Nominal keeps categories
    assert ltypes(back)["size"] == LType.NOMINAL and categories(back, "size") == order
    free = ToCategorical(attributes={"n": {}})(df)
    assert col(free, "n") == [None if v is None else repr(v) for v in nums]
    assert categories(free, "n") == sorted({repr(v) for v in nums if v is not None})


def test_wide_categories_have_no_list(spark, monkeypatch):
    monkeypatch.setattr("tableprep.operators.convert.LISTED", 50)
    df = spark.range(300).selectExpr("id", "concat('k', id % 120) AS k")
    wide = ToCategorical(attributes={"k": {}})(df)
    assert ltypes(wide)["k"] == LType.NOMINAL and categories(wide, "k") is None
    from tableprep.operators.encode import CategoryCodes
    names = sorted(f"k{j}" for j in range(120))
    assert col(CategoryCodes(attributes=["k"])(wide), "k", "id") == [names.index(f"k{i % 120}") for i in range(300)]
    with pytest.raises(Exception):
        ToCategorical(attributes={"k": {}}, max_categories=100)(df)


def test_wide_categories_act_like_listed_ones(spark, monkeypatch):
    """10,001 values (a stored table) give what a list of them gives, in every operator that uses categories."""
    from tableprep.operators.chartdata import scatter_data, series_data
    from tableprep.operators.encode import CategoryCodes, OneHotEncoder
    from tableprep.operators.join import Join
    from tableprep.operators.order import SortRows
    from tableprep.operators.profile import value_counts
    df = spark.range(10_001).selectExpr("cast(id as int) AS i", "concat('k', id) AS k")
    swap = {"k": {"values": [["k9999", "k3"], ["k10", None]], "replace": ["a0", None]}}

    def all_of(cat):
        few = cat.where("i % 1000 = 7")
        swapped = ReplaceValues(table=swap)(cat)
        turned = ReplaceValues(table={"k": {"values": [["k5", "k77", "k4000"]], "replace": ["other"]}}, inverted=True)(cat)
        joined = Join(on="columns", left_on="k", right_on="k", how="left")(few, few)
        sort = lambda t: [tuple(r) for r in t.collect()]
        return {
            "ltypes": [ltypes(x)["k"] for x in (cat, few, swapped, turned, joined)],
            "filtered codes": col(CategoryCodes(attributes=["k"])(few), "k"),
            "swapped codes": col(CategoryCodes(attributes=["k"])(swapped.where("i % 1000 = 3 or i > 9990")), "k"),
            "turned codes": col(CategoryCodes(attributes=["k"])(turned.where("i < 90")), "k"),
            "joined codes": sorted(r["k"] for r in CategoryCodes(attributes=["k"])(joined).collect()),
            "scatter": sorted(sort(scatter_data(few, ["i", "k"]))),
            "series": sorted(sort(series_data(few, "k", "i"))),
            "counts": sorted(sort(value_counts(few, "k"))),
            "swapped counts": sorted(sort(value_counts(swapped, "k"))),
            "order": [r["i"] for r in SortRows(by="k", ascending=False)(swapped.where("i > 9990 or i < 5")).collect()],
            "onehot": OneHotEncoder(attributes=["k"])(turned).columns}

    def made(listed):
        monkeypatch.setattr("tableprep.operators.convert.LISTED", listed)
        cat = ToCategorical(attributes={"k": {"ordered": True}})(df)
        assert (categories(cat, "k") is None) == (listed == 10_000)
        return all_of(cat)

    wide, short = made(10_000), made(20_000)
    for name, want in short.items():
        assert wide[name] == want, name


def test_to_timestamp(spark):
    days = [datetime(2003, 2, 1), datetime(1987, 11, 30), None]
    texts = [None if d is None else d.strftime("%d/%m/%Y") for d in days]
    df = spark.createDataFrame(list(zip(range(3), texts, ["March 1999", "soon", None])), "i int, d string, m string")
    out = ToTimestamp(attributes={"d": {"format": "%d/%m/%Y"}})(df)
    assert col(out, "d") == days and ltypes(out)["d"] == LType.DATETIME
    with pytest.raises(Exception):
        ToTimestamp(attributes={"m": {"format": "%B %Y"}}, errors="raise")(df).collect()
    ok = ToTimestamp(attributes={"m": {"format": "%B %Y"}}, errors="coerce")(df)
    assert col(ok, "m") == [datetime(1999, 3, 1), None, None]
    with pytest.raises(OptionError):
        ToTimestamp(attributes={"m": {"format": "%Q"}})


def test_to_string_python_layout(spark):
    vals = [3.0, 1e7, 1e-5, 1.5e16, 0.1, -2.5e8, 1.2e-10, 1e22, 123456789.123, 0.00012345, 2e23,
            4.07748826219687e-250, 1.7976931348623157e308, 5e-324, 1.3116923000000002e+17]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    out = ToString(attributes=["x"])(df)
    assert col(out, "x") == [repr(v) for v in vals]


X, Y = [8.0, 1.0, 5.0, 8.0, None, 2.0], [0.0, 7.0, 7.0, 3.0, 9.0, None]


def replaced(values, groups, inverted=False):
    """First group with the value wins; inverted: the first group without it (a missing value is in none)."""
    out = []
    for v in values:
        if v is None and not inverted:
            out.append(v)
            continue
        hit = [r for g, r in groups if (v in g) != inverted]
        out.append(float(hit[0]) if hit else v)
    return out


def test_replace_sequence_and_inverted(spark):
    df = spark.createDataFrame(list(zip(range(6), X, Y)), "i int, x double, y double")
    table = {"x": {"values": [[8, 2]], "replace": [40]}, "y": {"values": [[7, 3], [0]], "replace": [-5, -6]}}
    out = ReplaceValues(table=table)(df)
    assert col(out, "x") == replaced(X, [([8, 2], 40)]) and col(out, "y") == replaced(Y, [([7, 3], -5), ([0], -6)])
    inv = ReplaceValues(table={"x": table["x"]}, inverted=True)(df)
    assert col(inv, "x") == replaced(X, [([8, 2], 40)], True)


def test_replace_nominal_and_missing(spark):
    kinds = ["oak", "elm", "fir", "ash"]
    df = spark.createDataFrame(list(enumerate(kinds)), "i int, c string")
    df = df.select("i", F.col("c").alias("c", metadata={"ltype": "nominal", "categories": kinds}))
    out = ReplaceValues(table={"c": {"values": [["oak", "yew"], ["elm"], ["ash"]], "replace": ["fir", "tall elm", None]}})(df)
    assert col(out, "c") == ["fir", "tall elm", "fir", None] and ltypes(out)["c"] == LType.NOMINAL
    assert set(categories(out, "c")) == {"fir", "tall elm"}
    num = spark.createDataFrame([(0, 6.0), (1, None), (2, 12.0)], "i int, c double")
    out = ReplaceValues(table={"c": {"values": [["nan", 12], [6]], "replace": [-3, -4]}})(num)
    assert col(out, "c") == [-4.0, -3.0, -3.0]
