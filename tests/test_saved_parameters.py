"""Learned tables travel with saved graphs and saved rows."""

import json
import os
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tableprep.errors import SchemaError
from tableprep.functions import params
from tableprep.functions.category_table import open_table
from tableprep.ltypes import category_source, field_of
from tableprep.operators.convert import ToCategorical
from tableprep.operators.encode import CategoryCodes
from tableprep.plans.dag import StepGraph
from tableprep.sources.parquet import read_parquet, write_table

CODES = [{"id": "in", "step": "input", "options": {"table": "t"}},
         {"id": "codes", "step": "category_codes", "inputs": ["in"], "options": {"attributes": ["s"]}}]


def wide(spark, n):
    return spark.range(n).select(F.format_string("v%06d", (F.col("id") * 7919) % n).alias("s"), F.col("id").alias("k"))


def gone(spark, ref):
    """Whether the table a reference names was made unreadable by moving it away."""
    path = ref["table"].removeprefix("file:")
    os.rename(path, path + "-elsewhere")


@pytest.mark.parametrize("n", [3, 64, 65, 10_050])
def test_saved_graph_holds_its_codes(spark, tmp_path, n):
    g = StepGraph(CODES)
    g.run(spark, {"t": wide(spark, n)})
    learned = g.fitted["codes"]["categories"]["s"]
    assert isinstance(learned, list) == (n <= 64)
    assert "DataFrame" not in g.to_json(fitted=g.fitted)
    g.save(spark, str(tmp_path / "g"), g.fitted)
    if isinstance(learned, dict):
        gone(spark, learned)  # the folder needs nothing outside it
    os.rename(tmp_path / "g", tmp_path / "moved")
    other = spark.newSession()
    back = StepGraph.load(other, str(tmp_path / "moved"))
    assert back.nodes == g.nodes
    rows = other.createDataFrame([(f"v{i:06d}", i) for i in (0, 1, 2, n - 1)] + [("other", None), (None, None)], "s string, k long")
    results, _ = back.run(other, {"t": rows}, fitted=back.saved_fitted)
    assert [tuple(r) for r in results["codes"].df.collect() if r["s"] != r["k"]] == []
    # and the same on a stream
    src = str(tmp_path / "src")
    rows.write.parquet(src)
    nodes = [dict(CODES[0], options={"stream_parquet": src, "schema": "s string, k long"}), CODES[1],
             {"id": "out", "step": "output", "inputs": ["codes"], "options": {"stream_table": f"tp_codes_{n}", "checkpoint": str(tmp_path / "ck")}}]
    live = StepGraph(nodes)
    live.run(spark, fitted=StepGraph.load(spark, str(tmp_path / "moved")).saved_fitted)
    for query in live.queries:
        query.awaitTermination(120)
    got = spark.table(f"tp_codes_{n}").collect()
    assert len(got) == 6 and all(r["s"] == r["k"] for r in got)
    spark.sql(f"DROP TABLE tp_codes_{n}")


def test_what_json_cannot_hold(spark, tmp_path):
    x = {"a": [1, 2.5, None, True, "x"], "b": {"t": datetime(2020, 1, 2, 3, 4, 5, 6), "d": date(2020, 1, 2), "m": Decimal("1.20")}}
    assert params.loads(params.dumps(x)) == x
    g = StepGraph(CODES)
    for bad in (spark.range(1), {1, 2}, {3: "x"}, object()):
        with pytest.raises(TypeError, match="cannot be saved"):
            g.to_json(fitted={"codes": {"categories": bad}})
    with pytest.raises(Exception, match="PATH_NOT_FOUND|no saved graph"):
        StepGraph.load(spark, str(tmp_path / "none"))
    json.loads(g.to_json())


@pytest.mark.parametrize("parts", [None, ["p"]])
def test_saved_rows_hold_their_categories(spark, tmp_path, parts):
    df = wide(spark, 10_050).withColumn("p", F.col("k") % 2)
    cats = ToCategorical(attributes={"s": {"cat": None, "ordered": True}})(df)
    two = cats.withColumn("again", F.col("s").alias("again", metadata=field_of(cats, "s").metadata))
    path = str(tmp_path / "rows")
    write_table(two, path, partition_by=parts)
    gone(spark, category_source(field_of(cats, "s")))
    os.rename(path, path + "-moved")
    back = read_parquet(spark, path + "-moved")
    assert back.count() == 10_050
    assert len([x for x in os.listdir(os.path.join(path + "-moved", "_categories")) if not x.startswith(".")]) == 1
    coded = CategoryCodes(attributes=["s", "again"])(back.filter("k % 5 = 0"))
    name = F.format_string("v%06d", F.col("s"))
    assert coded.filter((F.col("s") != F.col("again")) | (name != F.format_string("v%06d", (F.col("k") * 7919) % 10_050))).count() == 0
    # saved again from there, and over itself elsewhere
    write_table(back, path + "-two")
    write_table(back, path + "-two")
    again = read_parquet(spark, path + "-two")
    assert open_table(spark, category_source(field_of(again, "s"))).count() == 10_050
    with pytest.raises(SchemaError, match="read_table"):
        CategoryCodes(attributes=["s"])(spark.read.parquet(path + "-two"))


def test_chained_fits_from_one_aggregate(spark, monkeypatch):
    """Mean fill, min-max and standard scaling of a chain: one look at the rows, the parameters of fitting step by step."""
    from tableprep.functions import summaries
    from tableprep.operators.fill import FillNan
    from tableprep.operators.scale import MinMaxScaler, StandardScaler
    rows = [(i, None if i % 4 == 0 else float(i * i % 37) - 5, None if i % 3 else i, None) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, x double, n int, e double").repartition(3)
    right = spark.range(50).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2.5).alias("y"))
    steps = [("fill", "fill_nan", {"method": "mean", "selected": ["x", "y", "n", "e"]}),
             ("scale", "minmax_scaler", {"attributes": {"x": {"range": [0, 2]}, "n": {"range": [0, 1]}, "e": {}}}),
             ("std", "standard_scaler", {"attributes": ["y"]}), ("again", "minmax_scaler", {"attributes": {"x": {"range": [5, 6]}}})]
    nodes = [{"id": "a", "step": "input", "options": {"table": "a"}}, {"id": "b", "step": "input", "options": {"table": "b"}},
             {"id": "j", "step": "join", "inputs": ["a", "b"], "options": {"on": "columns", "left_on": "k", "right_on": "k", "how": "left"}}]
    last = "j"
    for nid, step, options in steps:
        nodes.append({"id": nid, "step": step, "inputs": [last], "options": options})
        last = nid
    looks = []
    keep = summaries.measure
    monkeypatch.setattr(summaries, "measure", lambda d, cols: looks.append(sorted(cols)) or keep(d, cols))
    g = StepGraph(nodes)
    results, report = g.run(spark, {"a": df, "b": right})
    assert looks == [["e", "n", "x", "y"], ["x"]]  # a scaled column is looked at again
    cur = results["j"].df
    for (nid, _, options), kind in zip(steps, (FillNan, MinMaxScaler, StandardScaler, MinMaxScaler)):
        model = kind(**options).fit(cur)
        for name, learned in model.params.items():
            assert g.fitted[nid][name].keys() == learned.keys()
            for c, v in learned.items():
                got = g.fitted[nid][name][c]
                assert got == v or abs(got - v) < 1e-9 * max(1, abs(v)), (nid, name, c)
        cur = model.transform(cur)
    a, b = ({r["k"]: tuple(r) for r in d.select("k", "x", "n", "e", "y").collect()} for d in (cur, results["again"].df))
    assert a.keys() == b.keys()
    for k in a:
        assert all(p == q or abs(p - q) < 1e-9 for p, q in zip(a[k], b[k]))
    assert ("fill", "learned", "means") in {(r[0], r[2], r[3]) for r in report}
    assert g._cache_nodes() == set()  # one chain of fits: the join is not stored for it
    ranked = {"id": "bins", "step": "bins_discretizer", "inputs": ["fill"], "options": {"attributes": {"x": {"bins": 3}}, "strategy": "quantile"}}
    assert StepGraph([*nodes[:4], ranked])._cache_nodes() == {"j"}  # a second, other fit
