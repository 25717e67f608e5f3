"""A1-A7 (brute force), S1/S5-S8/S9/S10/S12, G1/G4-G6, streaming contract, driver entry."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tableprep.errors import GraphError, OptionError, StreamingError
from tableprep.functions.quantiles import exact_quantiles
from tableprep.ltypes import LType, categories, ltypes
from tableprep.operators import profile as P
from tableprep.operators.convert import ToCategorical
from tableprep.operators.fill import FillNan
from tableprep.operators.scale import MinMaxScaler
from tableprep.plans.dag import StepGraph
from tableprep.sources import catalog, parquet
from tableprep.sources import csv as csvsrc
from tableprep.streaming import stream as S

from helpers import SF0001, SF001


def test_exact_quantiles_brute_force(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet")
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    pdf = df.select(*cols).toPandas()
    for local_rows in (200_000, 500):  # direct window, and the bracket search
        q = exact_quantiles(df, {c: probs for c in cols}, local_rows=local_rows)
        for c in cols:
            assert np.allclose(q[c], np.percentile(pdf[c], [p * 100 for p in probs]), rtol=0, atol=1e-9)


def test_column_stats_against_pandas(spark):
    df = spark.read.parquet(f"{SF001}/orders.parquet")
    df = df.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", None).otherwise(F.col("o_totalprice")))
    s = {r["column"]: r for r in P.column_stats(df, ["o_totalprice", "o_orderstatus", "o_orderdate"]).collect()}
    pdf = df.toPandas()
    p = pdf["o_totalprice"].astype(float)
    r = s["o_totalprice"]
    assert r["missing"] == p.isna().sum() and abs(r["mean"] - p.mean()) < 1e-6 and abs(r["std"] - p.std()) < 1e-6
    assert np.allclose([r["q25"], r["q50"], r["q75"]], p.quantile([0.25, 0.5, 0.75]).values)
    vc = pdf["o_orderstatus"].value_counts()
    assert s["o_orderstatus"]["unique"] == len(vc) and s["o_orderstatus"]["top_count"] == vc.max()
    assert s["o_orderdate"]["first"] == pdf["o_orderdate"].min()
    with pytest.raises(Exception):
        P.column_stats(df.limit(0))


def test_histogram_matches_pandas_cut(spark):
    df = spark.read.parquet(f"{SF001}/lineitem.parquet")
    h = P.histogram(df, "l_extendedprice", bins=20).orderBy("bucket").collect()
    v = df.select("l_extendedprice").toPandas()["l_extendedprice"]
    ref = pd.cut(v, 20).value_counts(sort=False).values
    assert [r["count"] for r in h] == list(ref)
    const = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    hc = P.histogram(const, "x", bins=4).collect()
    assert sum(r["count"] for r in hc) == 2 and len(hc) == 4


def test_value_and_missing_counts(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "c string")
    df = ToCategorical(attributes={"c": {"cat": ["a", "b", "z"]}})(df)
    assert {r["value"]: r["count"] for r in P.value_counts(df, "c").collect()} == {"a": 2, "b": 1, "z": 0}
    assert P.missing_counts(df).collect()[0]["missing"] == 1


def test_csv_roundtrip_and_typing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1.5, None), (2, "NA", 0.1, True)], "a int, b string, c double, d boolean")
    path = str(tmp_path / "out")
    csvsrc.write_csv(df, path, sep="\\t", index=False)
    back = csvsrc.read_csv(spark, path, sep="tab")
    assert dict(back.dtypes) == {"a": "double", "b": "string", "c": "double", "d": "boolean"}
    assert sorted(r["b"] or "-" for r in back.collect()) == ["-", "x"]  # "NA" reads as missing
    given = csvsrc.read_csv(spark, path, sep="tab", schema="a double, b string, c double, d boolean")
    assert sorted(r["b"] or "-" for r in given.collect()) == ["-", "x"]
    g = spark.createDataFrame([(123456789.0,), (0.1,), (1e-7,), (0.0,), (None,)], "x double")
    got = [r[0] for r in g.select(csvsrc.float_format_expr(F.col("x"), "%g")).collect()]
    assert got == ["%g" % 123456789.0, "%g" % 0.1, "%g" % 1e-7, "0", None]


def test_parquet_keeps_types_and_index(spark, tmp_path):
    from tableprep.operators.columns import SetIndex
    from tableprep.table import Table
    df = ToCategorical(attributes={"c": {"cat": ["b", "a"], "ordered": True}})(
        spark.createDataFrame([(1, "a"), (2, "b")], "k int, c string"))
    t = SetIndex(columns=["k"])(Table(df))
    path = str(tmp_path / "p")
    parquet.write_table(Table(t.df.coalesce(1), t.index), path, max_records_per_file=1)
    back = parquet.read_table(spark, path)
    assert back.index == ("k",) and ltypes(back.df)["c"] == LType.ORDINAL and categories(back.df, "c") == ["b", "a"]
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) == 2


def test_catalog(spark):
    catalog.to_variable(spark.range(3), "tp_t1")
    assert "tp_t1" in catalog.list_tables(spark)
    catalog.rename_table(spark, "tp_t1", "tp_t2")
    with pytest.raises(OptionError):
        catalog.rename_table(spark, "tp_t2", "tp_t2")
    assert catalog.set_input(spark, "tp_t2").df.count() == 3
    page = catalog.head(spark.range(100), n=5, offset=10, order_by="id")
    assert [r[0] for r in page.collect()] == [10, 11, 12, 13, 14]
    catalog.remove_table(spark, "tp_t2")
    assert "tp_t2" not in catalog.list_tables(spark)


NODES = [
    {"id": "in", "step": "input", "options": {"table": "t"}},
    {"id": "fill", "step": "fill_nan", "inputs": ["in"], "options": {"method": "mean", "selected": ["x"]}},
    {"id": "scale", "step": "minmax_scaler", "inputs": ["fill"], "options": {"attributes": {"x": {"range": [0, 1]}}}},
    {"id": "out", "step": "output", "inputs": ["scale"], "options": {"name": "tp_graph_out"}},
]


def test_graph_checks():
    with pytest.raises(GraphError):
        StepGraph(NODES + [{"id": "bad", "step": "drop_columns", "inputs": ["nope"], "options": {"columns": ["x"]}}])
    cyc = [{"id": "in", "step": "input", "options": {"table": "t"}},
           {"id": "a", "step": "drop_columns", "inputs": ["b"], "options": {"columns": ["x"]}},
           {"id": "b", "step": "drop_columns", "inputs": ["a"], "options": {"columns": ["x"]}}]
    with pytest.raises(GraphError):
        StepGraph(cyc)
    with pytest.raises(GraphError):
        StepGraph([{"id": "a", "step": "drop_columns", "inputs": [], "options": {"columns": ["x"]}}])
    with pytest.raises(OptionError) as e:  # every option error of every step, together
        StepGraph([{"id": "in", "step": "input", "options": {"table": "t"}},
                   {"id": "a", "step": "drop_columns", "inputs": ["in"], "options": {}},
                   {"id": "b", "step": "minmax_scaler", "inputs": ["a"], "options": {"attributes": {}}}])
    assert e.value.codes == ["a.not_given", "b.no_columns"]
    with pytest.raises(GraphError):
        StepGraph([{"id": "l", "step": "input", "options": {"table": "t"}},
                   {"id": "j", "step": "join", "inputs": ["l"], "options": {"left_on": "a", "right_on": "b"}}])


def test_graph_run_report_and_json(spark):
    t = spark.createDataFrame([(1, None), (2, 2.0), (3, 4.0)], "k int, x double")
    g = StepGraph(NODES)
    results, report = g.run(spark, {"t": t})
    assert sorted(r[0] for r in spark.table("tp_graph_out").select("x").collect()) == [0.0, 0.5, 1.0]
    kinds = {(r[0], r[2], r[3]) for r in report}
    assert ("fill", "learned", "means") in kinds and ("out", "result", "rows") in kinds
    rows = [r for r in report if r[0] == "out" and r[3] == "rows"]
    assert rows[0][4] == "3"
    g2 = StepGraph.from_json(g.to_json(fitted=g.fitted))
    assert g2.nodes == g.nodes and g2.saved_fitted["fill"]["means"]["x"] == 3.0
    # a saved, fitted graph applies to new data without refitting
    other = spark.createDataFrame([(9, None), (8, 10.0)], "k int, x double")
    res2, _ = g2.run(spark, {"t": other}, fitted=g2.saved_fitted)
    assert sorted(r[0] for r in res2["scale"].df.select("x").collect()) == [0.5, 4.0]
    assert g.report_df(spark, report).count() == len(report)


def test_streaming_contract(spark, tmp_path):
    src = str(tmp_path / "src")
    batch = spark.read.parquet(f"{SF0001}/events.parquet").select("event_id", "value", "event_type")
    batch.write.parquet(src)
    models = S.fit_on_batch([MinMaxScaler(attributes={"value": {"range": [0, 1]}}),
                             ToCategorical(attributes={"event_type": {"cat": ["click", "view"]}})], batch)
    stream = S.read_parquet_stream(spark, src, batch.schema)
    out = S.apply_models(models, stream)
    q = out.writeStream.format("memory").queryName("tp_stream_out").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("tp_stream_out")
    ref = models[1].transform(models[0].transform(batch))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
    with pytest.raises(StreamingError):
        FillNan(method="ffill", selected=["value"], order_by="event_id").fit(stream).transform(stream)
    with pytest.raises(StreamingError):
        MinMaxScaler(attributes={"value": {"range": [0, 1]}}).fit(stream)


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "price_band" in df.columns
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    missing = {n for n in set(q) - set(o) if not n.startswith("op") and n != "pipeline"}
    assert missing == set()


def test_register_user_step(spark):
    from tableprep.step import make, register_step
    register_step("double_x", lambda df: df.withColumn("x", F.col("x") * 2))
    df = spark.createDataFrame([(1.0,)], "x double")
    assert make("double_x")(df).collect()[0]["x"] == 2.0


def test_stream_sink_to_table(spark, tmp_path):
    src = str(tmp_path / "src2")
    batch = spark.read.parquet(f"{SF0001}/events.parquet").select("event_id", "value")
    batch.write.parquet(src)
    stream = S.read_parquet_stream(spark, src, batch.schema)
    model = MinMaxScaler(attributes={"value": {"range": [0, 1]}}).fit(batch)
    q = S.write_stream_table(model.transform(stream), "tp_stream_table", checkpoint=str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    got = spark.table("tp_stream_table")
    assert got.count() == batch.count()
    assert got.agg(F.min("value"), F.max("value")).collect()[0][:] == (0.0, 1.0)
    spark.sql("DROP TABLE IF EXISTS tp_stream_table")


def test_graph_fitted_on_batch_runs_on_stream(spark, tmp_path):
    src = str(tmp_path / "src3")
    batch = spark.read.parquet(f"{SF0001}/events.parquet").select("event_id", "value", "event_type")
    batch.write.parquet(src)
    nodes = [{"id": "in", "step": "input", "options": {"table": "events"}},
             {"id": "scale", "step": "minmax_scaler", "inputs": ["in"],
              "options": {"attributes": {"value": {"range": [0, 1]}}}},
             {"id": "out", "step": "output", "inputs": ["scale"], "options": {"name": "tp_batch_scaled"}}]
    g = StepGraph(nodes)
    g.run(spark, {"events": batch})
    saved = g.to_json(fitted=g.fitted)
    snodes = [dict(nodes[0], options={"stream_parquet": src, "schema": "event_id long, value double, event_type string"}),
              nodes[1], dict(nodes[2], options={"stream_table": "tp_stream_scaled",
                                                "checkpoint": str(tmp_path / "ck3")})]
    g2 = StepGraph(snodes)
    g2.run(spark, fitted=StepGraph.from_json(saved).saved_fitted)
    for q in g2.queries:
        q.awaitTermination(120)
    a = spark.table("tp_stream_scaled").select("event_id", "value")
    b = spark.table("tp_batch_scaled").select("event_id", "value")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    spark.sql("DROP TABLE IF EXISTS tp_stream_scaled")


def test_a_named_table_query_grows_with_the_data(spark):
    """Some named_table query stores and reads back more rows where the data has more."""
    import __spark_entry__ as E
    named = {k: v for k, v in E.queries().items() if k.startswith("named_table")}
    sql = E.oracle_sql()
    assert all(k in sql for k in named)
    n = {k: [f(spark, sf).count() for sf in (SF0001, SF001)] for k, f in named.items()}
    assert any(small < large for small, large in n.values())
