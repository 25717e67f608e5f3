"""Sharding: exact sizes, gapless slots, and the law of a uniform shuffle."""
import math
import time
import zlib
from collections import Counter

import numpy as np

from tableprep.llm import sharding
from tableprep.llm.sharding import _hypergeometric, communication_matrix, op10_shard, shuffle_shards

SF = "/root/testdata/sf0.01"


def check(rows, shards, n):
    by = {}
    for shard, slot in rows:
        by.setdefault(shard, []).append(slot)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op10_shard(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    check([(r["shard"], r["slot"]) for r in got], 16, len(docs))
    for r in got:
        b = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 1, zlib.crc32(b), "rows", None)


def test_query_moves_whole_documents(spark, monkeypatch):
    """Both permutations and the exchange carry the columns of ``documents``, the text among them."""
    seen = []
    keep = sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, *a: seen.append(df.columns) or keep(df, *a))
    out = op10_shard(spark, "/root/testdata/sf0.001")
    want = set(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").columns)
    assert seen and want <= set(seen[0])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "Window [row_number()" in x)
    assert "crc32" not in plan[plan.index(window):] and "text#" in plan[plan.index(window):]


def test_matrix_sums_and_law():
    rows = [5, 0, 100, 37, 1, 1000]
    m = communication_matrix(rows, 7, 1)
    assert m.sum(axis=1).tolist() == rows and m.sum() == sum(rows)
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    # two partitions of 6 and 4 rows into two shards: the hypergeometric law
    seen = Counter(int(communication_matrix([6, 4], 2, s)[0, 0]) for s in range(4000))
    for k in range(1, 6):
        p = math.comb(5, k) * math.comb(5, 6 - k) / math.comb(10, 6)
        assert abs(seen[k] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000) + 1e-3


def test_a_million_partitions_in_seconds(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 3000, 1_000_000)
    t = time.time()
    m = communication_matrix(rows, 16, 3)
    assert time.time() - t < 60
    assert (m.sum(axis=1) == rows).all() and (m >= 0).all()
    assert m.sum(axis=0).max() - m.sum(axis=0).min() <= 1
    # each cell has the hypergeometric mean and variance of its row
    n, total = rows.astype(float), float(rows.sum())
    z = (m[:, 0] - n / 16)[rows > 100] / np.sqrt(n * (1 / 16) * (15 / 16) * (1 - n / total))[rows > 100]
    assert abs(z.mean()) < 0.01 and abs(z.var() - 1) < 0.02
    # as a table it comes in pieces and no number stands in the plan
    monkeypatch.setattr(sharding, "MATRIX_ROWS", 1_000)
    few = sharding._matrix_table(spark, np.arange(4_500), m[:4_500].cumsum(axis=1))
    assert len(few._jdf.queryExecution().optimizedPlan().toString()) < 2_000
    got = sorted(tuple(r) for r in few.collect())
    assert [p for p, _ in got] == list(range(4_500)) and (np.array([u for _, u in got]) == m[:4_500].cumsum(axis=1)).all()


def test_three_partitions_keep_the_joint_law():
    """Over many seeds: every cell of a 3 x 3 matrix against the exact probability of the first row."""
    seen = Counter(tuple(communication_matrix([4, 3, 2], 3, s)[1].tolist()) for s in range(6000))
    for a in range(4):
        for b in range(4 - a):
            c = 3 - a - b
            p = math.comb(3, a) * math.comb(3, b) * math.comb(3, c) / math.comb(9, 3)
            assert abs(seen[a, b, c] / 6000 - p) < 4 * math.sqrt(p * (1 - p) / 6000) + 1e-3


def test_draw_beyond_library_range():
    rng = np.random.default_rng(3)
    good, bad, n = 2 * 10**9, 10**10, 10_000
    draws = np.array([_hypergeometric(rng, good, bad, n) for _ in range(800)])
    p = good / (good + bad)
    assert abs(draws.mean() - n * p) < 5 * math.sqrt(n * p * (1 - p) / 800)
    assert 0.8 < draws.var() / (n * p * (1 - p)) < 1.25
    assert _hypergeometric(rng, 0, 10**10, 5) == 0 and _hypergeometric(rng, 10**10, 0, 5) == 5


def test_places_are_uniform(spark):
    """Over seeds, a row lands in every shard equally often, whatever its partition."""
    docs = spark.range(0, 64, 1, 4).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    seen = np.zeros((64, 4))
    for seed in range(24):
        out, shard, slot = shuffle_shards(docs, shards=4, seed=seed * 10)
        rows = out.select("doc_id", shard, slot).collect()
        check([(r[1], r[2]) for r in rows], 4, 64)
        for d, s, _ in rows:
            seen[d, s] += 1
    # chi-square over 64 x 4 cells of mean 6; partitions do not stick to shards
    assert ((seen - 6) ** 2 / 6).sum() < 192 + 5 * math.sqrt(2 * 192)
    by_part = seen.reshape(4, 16, 4).sum(axis=1)
    assert np.abs(by_part - 96).max() < 40


def test_odd_rows(spark, empty_docs):
    rows = [(None, None)] * 3 + [(1, "")] * 2 + [(2, "x" * 300_000)] + [(3, "same")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS Slot", "3 AS shard_upto")
    out, shard, slot = shuffle_shards(docs, shards=5)
    assert out.columns[:5] == docs.columns and shard != "shard" and slot.lower() != "slot"
    check([(r[0], r[1]) for r in out.select(shard, slot).collect()], 5, len(rows))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in rows)
    assert shuffle_shards(empty_docs)[0].count() == 0
    assert sorted(r[0] for r in shuffle_shards(docs.limit(2))[0].select(slot).collect()) == [0, 0]
