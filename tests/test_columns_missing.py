"""P1-P7, P11, P12 and F1-F6 on small tables."""

import pytest
from pyspark.sql import functions as F

from tableprep.errors import OptionError, SchemaError
from tableprep.ltypes import LType, ltypes
from tableprep.operators import columns as C
from tableprep.operators import missing as M
from tableprep.table import Table

from helpers import col


@pytest.fixture
def base(spark):
    return spark.createDataFrame(
        [(0, 1.0, 3.0, "q", "05-09-1988"), (1, 2.0, 4.0, "2", "22-12-1994"), (2, 3.0, 5.0, "c", "21-11-1995"),
         (3, 4.0, 6.0, "4", "22-06-1994"), (4, 10.0, 0.0, "x", "12-12-2012")],
        "i int, col1 double, col2 double, col3 string, date string")


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame(
        [(0, 1.0, 3.0, "q", "a"), (1, 2.0, 4.0, "2", "b"), (2, 3.0, None, "c", "c"),
         (3, None, None, "4", "d"), (4, 10.0, None, "x", "e")],
        "i int, col1 double, col2 double, col3 string, date string")


def test_drop_keeps_index(base):
    t = C.SetIndex(columns=["col1"])(Table(base.drop("i")))
    out = C.DropColumns(columns=["col2", "date"])(t)
    assert out.columns == ["col3"] and out.index == ("col1",)
    with pytest.raises(OptionError):
        C.DropColumns(columns=[])


def test_duplicate_appends_and_rejects_clash(base):
    out = C.DuplicateColumns(table={"col1": "a name", "col3": "new"})(base)
    assert out.columns[-2:] == ["a name", "new"]
    assert col(out, "a name") == col(out, "col1")
    with pytest.raises(SchemaError):
        C.DuplicateColumns(table={"col1": "col2"})(base)
    with pytest.raises(OptionError) as e:
        C.DuplicateColumns(table={"col1": "x", "col2": "x"})
    assert "unique" in e.value.codes


def test_rename_swap_and_duplicates(base):
    out = C.RenameColumns(names={"col1": "col4", "col3": "col1"})(base.drop("date"))
    assert out.columns == ["i", "col4", "col2", "col1"]
    sw = C.RenameColumns(names={"col1": "col2", "col2": "col1"})(base)
    assert col(sw, "col2") == [1.0, 2.0, 3.0, 4.0, 10.0]
    with pytest.raises(SchemaError):
        C.RenameColumns(names={"col1": "col2"})(base)
    with pytest.raises(SchemaError):
        C.rename_all(base, ["a", "b"])


def test_select_regex_and_type(base):
    assert C.select_by(base, regex="COL[12]").columns == ["col1", "col2"]
    assert C.select_by(base, types=["string"]).columns == ["col3", "date"]


def test_set_reset_index_types_kept_and_clash(base):
    cat = base.select("*", F.col("col3").alias("col3c", metadata={"ltype": "ordinal", "categories": ["q", "2", "c", "4", "x"]}))
    t = C.SetIndex(columns=["col3c"])(Table(cat))
    assert "col3c" not in t.columns and t.index == ("col3c",)
    t = C.DuplicateColumns(table={"col2": "col3c"})(t)  # a column named like the index level
    back = C.ResetIndex()(t)
    assert back.columns[0] == "col3c_index" and back.index == ()
    assert ltypes(back.df)["col3c_index"] == LType.ORDINAL


def test_set_index_replaces_old(base):
    t = C.SetIndex(columns=["col1"])(Table(base))
    t2 = C.SetIndex(columns=["col2"])(t)
    assert t2.index == ("col2",) and "col1" not in t2.df.columns and "__ix__col1" not in t2.df.columns


def test_table_info_and_ints(base):
    t = C.SetIndex(columns=["i"])(Table(base))
    r = C.table_info(t).collect()[0]
    assert (r["rows"], r["columns"], r["index_levels"], r["index_names"]) == (5, 4, 1, "i")
    out = C.IntsToFloats()(base)
    assert dict(out.dtypes)["i"] == "double"


def test_rows_by_missing_count_and_share(nulls):
    assert M.RemoveNanRows(number=1)(nulls).count() == 4
    assert M.RemoveNanRows(percentage=0.3)(nulls.drop("i")).count() == 4
    assert M.RemoveNanRows(percentage=0.5)(nulls.drop("i")).count() == 5
    assert M.RemoveNanRows(percentage=0.0)(nulls).count() == 2  # a share of 0.0 is valid
    with pytest.raises(OptionError):
        M.RemoveNanRows(number=1, percentage=0.2)


@pytest.mark.parametrize("opts,expected", [
    ({"percentage": 0.3}, ["col3", "date"]), ({"number": 3}, ["col2", "col3", "date"]),
    ({"number": 0}, ["col3"]), ({"percentage": 0.6}, ["col2", "col3", "date"]),
    ({"percentage": 0.59}, ["col3", "date"])])
def test_columns_by_missing(nulls, opts, expected):
    one_missing = nulls.withColumn("date", F.when(F.col("i") == 3, None).otherwise(F.col("date")))
    t = C.SetIndex(columns=["col1"])(Table(one_missing.drop("i")))
    m = M.RemoveNanColumns(**opts).fit(t)
    out = m.transform(t)
    assert out.columns == expected and out.index == ("col1",)


def test_keep_values_and_drop_missing(spark, nulls):
    t = C.SetIndex(columns=["i"])(Table(nulls))
    assert M.KeepIndexValues(values=[1, 3])(t).df.count() == 2
    vals = spark.createDataFrame([(0,), (4,)], "v int")
    assert M.keep_values_in(nulls, "i", vals).count() == 2
    assert M.DropMissing(subset=["col1"])(nulls).count() == 4
    assert M.DropMissing()(nulls).count() == 2


def test_sort_rows_ordinal_and_hot_value(spark):
    from tableprep.operators.convert import ToCategorical
    from tableprep.operators.order import SortRows, append_tables
    df = spark.createDataFrame([(i, "b" if i % 3 else "a", None if i == 5 else i % 7) for i in range(300)],
                               "i int, c string, n int")
    df = ToCategorical(attributes={"c": {"cat": ["b", "a"], "ordered": True}})(df)
    out = SortRows(by=["c", "n"])(df).collect()
    keys = [(0 if r.c == "b" else 1, r.n if r.n is not None else 99) for r in out]
    assert keys == sorted(keys) and len(out) == 300
    desc = [r.i for r in SortRows(by="i", ascending=False)(df).collect()]
    assert desc == sorted(desc, reverse=True)
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2, 2.0)], "k int, d double")
    assert append_tables(a, b).columns == ["k", "s", "d"] and append_tables(a, b).count() == 2


def test_missing_share_of_wide_rows_is_compiled(spark):
    """98 computed cells in one generated method would be too long for the JVM to compile (over 8,000 bytes)."""
    import re

    from tableprep.operators.missing import RemoveNanRows
    gaps = 25 + F.col("id") % 9
    wide = spark.range(60).repartition(2).select("id", *[F.when(gaps <= j, F.lit(1)).alias(f"c{j}") for j in range(98)], F.lit(2).alias("z"))
    for options in ({"percentage": 0.29}, {"number": 29}):
        out = RemoveNanRows(**options)(wide).select("id")
        text = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "codegen")
        assert all(int(x) < 8000 for x in re.findall(r"maxMethodCodeSize:(\d+)", text))
        assert sorted(r["id"] for r in out.collect()) == [i for i in range(60) if 25 + i % 9 <= 29]
    assert RemoveNanRows(number=0)(wide).count() == 0
