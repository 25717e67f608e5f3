"""Radix selection on spreads that equal steps alone would take very many rounds for."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tableprep.functions import quantiles
from tableprep.functions.quantiles import exact_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def same(got, values):
    want = np.quantile(np.array(values), PROBS)
    for a, b in zip(got, want, strict=True):
        assert a == b or math.isclose(a, b, rel_tol=1e-12), (a, b)


def spread(n, seed):
    rng = random.Random(seed)
    return [rng.choice((-1, 1)) * rng.random() * 10.0 ** rng.uniform(-300, 300) for _ in range(n)]


def test_six_hundred_magnitudes(spark):
    """Rounds are bounded: the window at the end is never needed with ``local_rows=0``."""
    values = spread(20_000, 1) + [0.0] * 50 + [-0.0] * 7
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    seen = []
    keep = quantiles._Cells.rows
    quantiles._Cells.rows = lambda *a: seen.append(1) or keep(*a)
    try:
        got = exact_quantiles(df, {"x": PROBS}, local_rows=0)["x"]
    finally:
        quantiles._Cells.rows = keep
    same(got, values)
    assert len(seen) <= 6  # scans


def test_scans_do_not_grow_with_columns(spark):
    data = {"a": spread(3000, 2), "b": [float(i % 7) for i in range(3000)], "c": [1e6 + i for i in range(3000)],
            "d": [math.nextafter(1.0, 2) if i % 2 else 1.0 for i in range(3000)], "e": [5e-324 * (i % 9) for i in range(3000)],
            "f": [1.7e308 * (1 if i % 2 else -1) for i in range(3000)]}
    df = spark.createDataFrame(list(zip(*data.values(), strict=True)), ", ".join(f"{c} double" for c in data)).repartition(4)
    for local in (0, 100, 10**6):
        got = exact_quantiles(df, {c: PROBS for c in data}, local_rows=local)
        for c, values in data.items():
            if c != "f":
                same(got[c], values)
        assert got["f"][0] == -1.7e308 and got["f"][-1] == 1.7e308


def test_against_percentile(spark):
    df = spark.range(200_000).select((F.exp(F.randn(3) * 40)).alias("x"), F.when(F.col("id") % 3 == 0, F.lit(4.0)).otherwise(F.rand(4)).alias("y"))
    df = df.persist()
    want = df.agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS])), F.percentile("y", F.array(*[F.lit(p) for p in PROBS]))).first()
    got = exact_quantiles(df, {"x": PROBS, "y": PROBS}, local_rows=50)
    for c, w in zip(("x", "y"), want, strict=True):
        assert all(math.isclose(a, b, rel_tol=1e-12) for a, b in zip(got[c], w, strict=True))
    df.unpersist()
