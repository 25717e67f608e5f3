"""Wide one-hot encodings, as columns and sparse."""

import time

import pytest
from pyspark.sql import functions as F

from tableprep.errors import OptionError, SchemaError
from tableprep.ltypes import LType, ltypes
from tableprep.operators.convert import ToCategorical
from tableprep.operators.encode import OneHotEncoder, expand_onehot
from tableprep.plans.dag import StepGraph

ODD = ["it's", "back\\slash", "a.b", "`tick`", 'quo"te', "", "new\nline", "ünï"]


def test_odd_values_as_columns_and_sparse(spark):
    rows = [(i, v) for i, v in enumerate([*ODD, None, ODD[0]])]
    df = spark.createDataFrame(rows, "i int, s string")
    wide = OneHotEncoder(attributes=["s"], include_nan=True)(df)
    names = [f"s_{v}" for v in sorted(ODD)] + ["s_nan"]
    assert wide.columns == ["i", "s", *names]
    want = {i: [int(v == x) for x in sorted(ODD)] + [int(v is None)] for i, v in rows}
    assert {r[0]: list(r[2:]) for r in wide.collect()} == want
    assert all(ltypes(wide)[n] == LType.NOMINAL for n in names)
    sparse = OneHotEncoder(attributes=["s"], include_nan=True, output="sparse")(df)
    assert sparse.columns == ["i", "s", "s_onehot"]
    assert {r["i"]: (r["s_onehot"]["size"], r["s_onehot"]["index"]) for r in sparse.collect()} == {i: (9, x.index(1)) for i, x in want.items()}
    back = expand_onehot(sparse, "s_onehot")
    assert {r[0]: list(r[3:]) for r in back.collect()} == want
    some = expand_onehot(sparse, "s_onehot", ["a.b", "it's"])
    assert some.columns[3:] == ["s_a.b", "s_it's"]
    with pytest.raises(SchemaError, match="no category"):
        expand_onehot(sparse, "s_onehot", ["nope"])
    with pytest.raises(SchemaError, match="not a sparse"):
        expand_onehot(sparse, "s")
    with pytest.raises(OptionError):
        OneHotEncoder(attributes=["s"], output="dense")


def test_many_values(spark, tmp_path):
    """12,000 values: one sparse column planned in seconds, the same from a saved graph; 1,500 columns in seconds too."""
    df = spark.range(12_000).select(F.format_string("v%05d", F.col("id")).alias("s"), "id")
    t = time.time()
    model = OneHotEncoder(attributes=["s"], output="sparse").fit(df)
    out = model.transform(df)
    out.schema  # planned
    assert time.time() - t < 30
    assert out.where(F.col("s_onehot.index") != F.col("id")).isEmpty() and out.where("s_onehot.size <> 12000").isEmpty()
    t = time.time()
    wide = expand_onehot(out, "s_onehot", [f"v{i:05d}" for i in range(0, 12_000, 8)])
    assert len(wide.columns) == 3 + 1_500 and time.time() - t < 15
    assert wide.where("s = 'v00016'").select("s_v00016", "s_v00008").first()[:] == (1, 0)
    g = StepGraph([{"id": "in", "step": "input", "options": {"table": "t"}},
                   {"id": "hot", "step": "onehot_encoder", "inputs": ["in"], "options": {"attributes": ["s"], "output": "sparse"}}])
    g.run(spark, {"t": df})
    g.save(spark, str(tmp_path / "g"), g.fitted)
    back = StepGraph.load(spark, str(tmp_path / "g"))
    few = spark.createDataFrame([("v00007",), ("new",), (None,)], "s string")
    got = back.run(spark, {"t": few}, fitted=back.saved_fitted)[0]["hot"].df.collect()
    assert {r["s"]: r["s_onehot"]["index"] for r in got} == {"v00007": 7, "new": None, None: None}


def test_1500_columns_are_planned_in_seconds(spark):
    df = ToCategorical(attributes={"s": {"cat": [f"c{i}" for i in range(1_500)]}})(spark.range(50).select(F.format_string("c%d", F.col("id")).alias("s")))
    t = time.time()
    out = OneHotEncoder(attributes=["s"])(df)
    assert len(out.columns) == 1_501
    assert time.time() - t < 15
