"""Clustering with a pivot table against plain loops."""
import hashlib
import math

import numpy as np
import pytest

from tableprep.llm.laesa import choose_pivots, cluster_vectors, digest, nearest, op13_laesa, to_pivots

SF = "/root/testdata/sf0.01"


def plain(rows, dim, k, rounds, scale):
    """rows: (id, list or None) -> sorted [(id, cluster, distance)], centroids."""
    kept = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    by = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in by[:k]]

    def place(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(place(v)[1], []).append(v)
        for j, vs in groups.items():
            cents[j] = [sum(x) // len(vs) for x in zip(*vs, strict=True)]
    out = []
    for i, v in kept:
        d, j = place(v)
        out.append((i, j, d))
    return out, cents


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def test_query_equals_plain_loops(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    want, cents = plain(rows, 64, 16, 3, 64)
    got = op13_laesa(spark, "/root/testdata/sf0.001").collect()
    assert order((r["vec_id"], r["cluster"], r["distance"]) for r in got) == order(want)
    total = sum(d for _, _, d in want)
    for r in got:
        assert r["inertia"] == total and r["centroid_sha256"] == digest(cents[r["cluster"]])
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.5]), (1, [0.5, -0.5]), (1, [0.25, 3.0]), (None, [9.0, 9.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-0.001, 0.001])] + [(10, [7.0, 7.0])] * 40
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cluster string").repartition(5)
    for k in (1, 3, 100):
        want, cents = plain(rows, 2, k, 3, 8)
        out, got = cluster_vectors(df, dimension=2, clusters=k, scale=8)
        assert order(map(tuple, out.collect())) == order(want) and got.tolist() == cents
    out, _ = cluster_vectors(df.limit(0), dimension=2)
    assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance"]
    with pytest.raises(Exception, match="64 bits"):
        cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dimension=2)


def test_bounds_prune_and_change_nothing():
    rng = np.random.default_rng(5)
    hubs = rng.integers(-5000, 5000, (12, 8))
    x = (hubs[rng.integers(0, 12, 3000)] + rng.integers(-40, 40, (3000, 8))).astype(np.int64)
    cents = np.vstack([hubs, hubs[:2]]).astype(np.int64)  # two equal centroids: the smaller number wins
    pivots = choose_pivots(x[:200], 6)
    cluster, best, made = nearest(x, to_pivots(x, pivots), cents, pivots)
    d = ((x[:, None] - cents[None]) ** 2).sum(axis=2)
    assert (best == d.min(axis=1)).all() and (cluster == d.argmin(axis=1)).all()
    assert made < 0.4 * d.size


def test_sums_beyond_floats(spark):
    """Component sums above 2**53 stay exact."""
    big = (1 << 26) - 1
    rows = [(i, [float(big - i % 2), -float(big - i % 3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, cents = plain(rows, 2, 4, 2, 1)
    out, got = cluster_vectors(df, dimension=2, clusters=4, rounds=2, scale=1)
    assert order(map(tuple, out.collect())) == order(want) and got.tolist() == cents
