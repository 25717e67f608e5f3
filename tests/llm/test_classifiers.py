"""The two classifiers on labelled rows they did not learn from, and their parts against plain forms."""
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tableprep.llm import compress_quality as C
from tableprep.llm import toxicity as X
from tableprep.llm.labelled import clear_labels, logistic, sample_ids, sigmoid
from tableprep.llm.textblock import Words

SF = "/root/testdata/sf0.1"


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in C.op8_quality(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())
    rows = [(r["quality"], got[r["doc_id"]]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([q == r["predicted"] for q, r in rows]) > 0.93
    good, bad = ([r["score"] for q, r in rows if q == k] for k in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97


def test_quality_query_equals_plain_compression(spark):
    """The query's scores are those of the trained dictionaries and curve, text by text."""
    import zstandard
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    m = C.train(docs.select("doc_id", "text"), labels, learn=~C.held_out(F.col("label_id"), 5, 0))
    pack = [zstandard.ZstdCompressor(level=m.level, dict_data=zstandard.ZstdCompressionDict(d)) for d in (m.good, m.bad)]
    got = {r["doc_id"]: r for r in C.op8_quality(spark, sf).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        good, bad = (len(p.compress(raw)) for p in pack)
        want = 1 / (1 + np.exp(-(m.slope * (bad - good) / np.sqrt(len(raw) + 1) + m.shift)))
        assert abs(got[r["doc_id"]]["score"] - want) < 1e-9 and got[r["doc_id"]]["predicted"] == int(got[r["doc_id"]]["score"] >= 0.3)


def test_quality_learns_nothing_from_held_out_labels(spark):
    """Turning round the held-out labels changes no score."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    learn = ~C.held_out(F.col("label_id"), 5, 0)
    turned = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id"), 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(C.classify(docs, x, learn=learn)[0].collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_flags(spark):
    got = {r["doc_id"]: r for r in X.op5_toxicity(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = spark.read.parquet(f"{SF}/labels.parquet").collect()
    hit = [got[r["doc_id"]]["toxic"] for r in rows if r["toxic"] == 1]
    false = [got[r["doc_id"]]["toxic"] for r in rows if r["toxic"] == 0]
    assert np.mean(hit) > 0.95 and np.mean(false) < 0.01


def test_toxicity_on_unlabelled_half(spark):
    """Trained on half of the labels, the other half is found as well."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out, names = X.predict_toxicity(docs.select("doc_id", "text"), labels.filter("doc_id % 2 = 0"), {"toxic": F.col("toxic")})
    got = {r["doc_id"]: r[names["toxic"]] >= X.THRESHOLD for r in out.select("doc_id", names["toxic"]).collect()}
    rest = [(r["toxic"], got[r["doc_id"]]) for r in labels.filter("doc_id % 2 = 1").collect()]
    # some 4 % of the toxic labels sit on texts without a toxic word
    assert np.mean([g for t, g in rest if t]) > 0.9 and np.mean([g for t, g in rest if not t]) < 0.015


def test_features_equal_plain_sets():
    texts = ["The cat, THE cat!", "", "été étéx catalogue", "a", "cat catalog"]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    doc, feat = X._feature_hashes(Words(data, offsets, X._MAP))
    seen = {}
    for d, t in enumerate(texts):
        words = {w.encode() for w in re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", t.lower())}
        want = {("w", w) for w in words} | {(k, w[:k]) for w in words for k in X.PREFIXES if len(w) > k}
        mine = feat[doc == d].tolist()
        assert len(mine) == len(set(mine)) == len(want)
        seen[d] = (want, set(mine))
    shared = lambda a, b: len(seen[a][0] & seen[b][0]) == len(seen[a][1] & seen[b][1])
    assert all(shared(a, b) for a in seen for b in seen)


def test_known_features_equal_all_features():
    raw = [t.encode() for t in ("stemlonger stem x", "", "stem stem STEMMING other", "other")] * 3
    data, offsets = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    w = Words(data, offsets, X._MAP)
    doc, feat = X._feature_hashes(w)
    chosen = np.unique(feat)[::2]
    got = set(zip(*(x.tolist() for x in X._known_features(w, chosen))))
    assert got == {(d, int(np.searchsorted(chosen, f))) for d, f in zip(doc.tolist(), feat) if f in chosen}


def test_chain_feeds_earlier_logits():
    models = [(np.array([2.0, 0.0]), np.array([1.0, -2.0, 10.0, 0.5])), (np.zeros(2), np.array([0.0, 1.0, 9.0, 3.0, -1.0]))]
    out = X.chain_logits(np.array([0, 1]), np.array([0, 1]), 3, models)
    assert np.allclose(out, [[21.5, 3 * 8 - 1], [-1.5, 1 - 4.5 - 1], [0.5, 0.5]])


def test_a_folds_labels_do_not_reach_its_logits():
    """Whatever the labels of a fold, of both categories, its out-of-fold logits stay; of three categories too."""
    rng = np.random.default_rng(7)
    n, k = 200, 30
    x = (rng.random((n, k)) < 0.3).astype(np.float32)
    y = (rng.random((n, 3)) < 0.2 + 0.5 * x[:, :3]).astype(float)
    fold = np.arange(n) % X.FOLDS
    from itertools import combinations
    skips = [s for m in range(3) for s in combinations(range(X.FOLDS), m)]
    chosen = {s: np.sort(rng.choice(k, 20, replace=False)) for s in skips}
    weight = np.ones(n)
    plain = X.Fits(x, y, weight, fold, chosen)
    flipped = y.copy()
    flipped[fold == 2] = 1 - flipped[fold == 2]
    other = X.Fits(x, flipped, weight, fold, chosen)
    for c in (0, 1):
        a, b = plain.out_of_fold((), c), other.out_of_fold((), c)
        assert np.array_equal(a[fold == 2], b[fold == 2]) and not np.allclose(a[fold != 2], b[fold != 2])


def test_a_folds_labels_do_not_choose_its_features(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.random() < 0.5), i % X.FOLDS, [int(f) for f in np.flatnonzero(rng.random(40) < 0.4)]) for i in range(300)]

    def choose(rows):
        df = spark.createDataFrame(rows, "label_id int, flag0 int, fold int, features array<bigint>")
        sizes = {j: (sum(r[1] for r in rows if r[2] == j), sum(1 - r[1] for r in rows if r[2] == j)) for j in range(X.FOLDS)}
        return {s: set(v) for s, v in X._select(df, "flag0", sizes, [(), (1,), (2,)], 10).items()}
    a, b = choose(rows), choose([(i, 1 - f if k == 2 else f, k, v) for i, f, k, v in rows])
    assert a[(2,)] == b[(2,)] and a[()] != b[()] and a[(1,)] != b[(1,)]
    # against plain counting
    left = [r for r in rows if r[2] != 2]
    n1, n0 = sum(r[1] for r in left), sum(1 - r[1] for r in left)
    z = {}
    for f in range(40):
        one, every = sum(r[1] for r in left if f in r[3]), sum(f in r[3] for r in left)
        p = every / (n1 + n0)
        z[f] = abs(one / n1 - (every - one) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    assert a[(2,)] == set(sorted(z, key=lambda f: (-z[f], f))[:10])


def test_query_equals_plain_scoring(spark):
    """The query's probabilities are those of the trained chain, worked out text by text."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = X.train(docs.select("doc_id", "text"), labels, {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})
    at = {int(h): i for i, h in enumerate(chain.features)}
    got = {r["doc_id"]: (r["p_junk"], r["p_toxic"]) for r in X.op5_toxicity(spark, sf).collect()}
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        w = Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), X._MAP)
        have = sorted({at[int(h)] for h in X._feature_hashes(w)[1] if int(h) in at})
        logits = []
        for sure, weights in chain.weights:
            k = len(sure)
            z = weights[-1] + sum(weights[i] for i in have) + weights[k] * max([0, *(sure[i] for i in have)])
            logits.append(z + sum(weights[k + 1 + j] * min(X.CLIP, max(-X.CLIP, e)) for j, e in enumerate(logits)))
        want = [1 / (1 + np.exp(-z)) for z in logits]
        assert np.allclose(got[r["doc_id"]], want, atol=1e-5)


def test_logistic_finds_the_optimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    y = (rng.random(400) < sigmoid(x @ [1, -2, 0, .5] + .3)).astype(float)
    w = logistic(x, y, l2=0.5)
    p = sigmoid(np.hstack([x, np.ones((400, 1))]) @ w)
    grad = np.hstack([x, np.ones((400, 1))]).T @ (p - y) + np.array([.5] * 4 + [1e-3]) * w
    assert np.abs(grad).max() < 0.05


def test_labels_and_samples(spark):
    rows = [(1, 1), (1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 0), (5, 7)]
    clear = clear_labels(spark.createDataFrame(rows, "doc_id long, toxic int"), "doc_id", t=F.col("toxic"))
    assert sorted(tuple(r) for r in clear.collect()) == [(1, 1), (4, 0)]
    many = spark.range(1000).selectExpr("id AS label_id", "cast(id % 10 = 0 AS int) AS t")
    few, counts = sample_ids(many, ["t"], 60, 1)
    got = few.collect()
    assert sum(r["t"] for r in got) == 60 and len(got) == 120 and counts == {(0,): 900, (1,): 100}
    assert sample_ids(many.limit(0), ["t"], 60, 1)[0].count() == 0


def test_odd_rows(spark, empty_docs):
    long = "lorem ipsum dolor " * 20_000
    good = [(i, f"This is a quite ordinary sentence number {i} of a plain text about some thing.") for i in range(30)]
    bad = [(100 + i, "!!! ### $$$ %%% BUY!! NOW!! " * (1 + i % 4) + str(i)) for i in range(30)]
    rows = good + bad + [(200, None), (201, ""), (None, long), (203, long), (203, long), (1, "again the first id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS predicted", "3 AS p_bad")
    marks = [(i, 1, 0) for i, _ in good] + [(i, 0, 1) for i, _ in bad] + [(None, 1, 0), (999, 1, 0), (5, None, None), (200, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    out, score, predicted = C.classify(docs, labels)
    got = out.collect()
    assert len(got) == len(rows) and score != "score" and all(0 <= r[score] <= 1 for r in got)
    assert {r["doc_id"]: r[score] for r in got}[200] == {r["doc_id"]: r[score] for r in got}[201]
    assert np.mean([r[predicted] for r in got if r["doc_id"] in range(100, 130)]) < 0.2
    out, names = X.predict_toxicity(docs, labels, {"bad": F.col("toxic")})
    got = out.collect()
    assert len(got) == len(rows) and names["bad"] != "p_bad"
    assert all(r[names["bad"]] > 0.5 for r in got if r["doc_id"] in range(100, 130))
    assert all(r[names["bad"]] < 0.5 for r in got if r["doc_id"] in range(2, 30))
    none = labels.limit(0)
    assert all(r[0] == 0.5 for r in C.classify(docs, none)[0].select(score).collect())
    assert all(r[0] < 0.01 for r in X.predict_toxicity(docs, none, {"bad": F.col("toxic")})[0].select(names["bad"]).collect())
    assert C.classify(empty_docs, labels)[0].count() == 0
    assert X.predict_toxicity(empty_docs, labels, {"bad": F.col("toxic")})[0].count() == 0
