"""Ranked search by norm buckets against scoring every pair."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tableprep.llm import lemp
from tableprep.llm.lemp import Best, Bucket, Block, op11_lemp, search

SF = "/root/testdata/sf0.001"


def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)


def plain(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, total = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for i, b, n in bags:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = 0
            for t in terms(text):
                if b[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m))
            if s > 0:
                found.append((-s, i is not None, i or 0))
        out += [(item, r + 1, i if known else None, -s) for r, (s, known, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def run(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_equals_scoring_every_pair(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert run(op11_lemp(spark, SF)) == plain(docs, items)


@pytest.mark.parametrize("bucket,block_bytes", [(3, 60), (50, 10**6)])
def test_ties_copies_and_blocks(spark, monkeypatch, bucket, block_bytes):
    monkeypatch.setattr(lemp, "BUCKET", bucket)
    monkeypatch.setattr(lemp, "FIRST", 30)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(40)], k=rng.randint(1, 30)))) for i in range(300)]
    docs += [(1000 - i, "w5, W7! w9 w9") for i in range(90)] + [(None, "w7 w9 w39")] * 3 + [(5, "w30 w31")] * 25
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)] + [(3, "w30 w31 w30"), (99, "zz"), (98, None), (97, "?!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = run(search(d, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes))
    assert got == plain(docs, items)


def test_odd_rows(spark, empty_docs):
    long = "alpha " * 50_000 + "omega"
    docs = [(None, None), (1, ""), (2, "\x00?"), (3, long), (4, "Straße Été x²"), (4, "Straße Été x²"),
            (5, "y" * 100_000), (6, "ALPHA beta"), (7, "a-b_c")]
    items = [("p", "Alpha omega"), ("q", "straße été X²"), ("p", "b c"), (None, "y" * 100_000), ("r", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS score", "3 AS rank")
    b = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "'x' AS k")
    assert run(search(d, b)) == plain(docs, items)
    assert search(empty_docs, b).count() == 0 and search(d, b.limit(0)).count() == 0
    out = search(d.limit(0), b)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_prune_and_keep_the_best():
    """A bucket whose lengths cannot reach the threshold is not touched; inside one few documents are scored."""
    rng = np.random.default_rng(2)
    block = Block([(0, b"t3 t4 t5 t6 t7")])
    size, n = len(block.vocabulary), 500
    dense = np.where(rng.random((n, size)) < 0.3, rng.integers(1, 300, (n, size)), 0)
    dense[:25] *= 100
    dense = dense[(dense > 0).any(axis=1)]
    length = np.sqrt((dense ** 2.0).sum(axis=1))
    dense, length = dense[np.argsort(-length)], np.sort(length)[::-1]
    ends = np.append(0, np.cumsum((dense > 0).sum(axis=1)))
    bucket = Bucket(length, ends, np.nonzero(dense)[1], dense[dense > 0], size)
    weights = np.array([50, 40, 3, 2, 1], np.int64)
    want = dense[:, block.terms] @ weights
    lo, hi, most = bucket.lists(block.terms)
    norm = float(np.sqrt((weights ** 2.0).sum()))
    for least in (0, int(np.sort(want)[-40]), int(want.max()), int(want.max()) + 1):
        best = Best(20, least)
        docs, score = bucket.search(block.terms, weights, norm, lo, hi, most, best)
        assert dict(zip(docs.tolist(), score.tolist(), strict=True)) == {i: s for i, s in enumerate(want.tolist()) if s > 0 and s >= least}
    seen = []
    bucket.exact = lambda d, *a, f=bucket.exact: seen.append(len(d)) or f(d, *a)
    bucket.search(block.terms, weights, norm, lo, hi, most, Best(20, int(np.sort(want)[-20])))
    assert sum(seen) < 100
    assert len(bucket.search(block.terms, weights, norm, lo, hi, most, Best(20, int(norm * length[0]) + 10))[0]) == 0 and len(seen) == 1
