"""Consistent weighted sampling against the same draws in plain Python, and against exact similarities."""
import hashlib
import math
import re
import struct
from collections import Counter

import pytest
import xxhash

from tableprep.llm.cws import CHUNK, SAMPLES, beside_next, compare_edited, fingerprints, likeness, op12_cws

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def bag(text):
    return Counter(re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()) or [""])


def jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def h64(seed, *parts):
    for p in parts:
        raw = p if isinstance(p, bytes) else struct.pack("<i" if isinstance(p, tuple) else "<q", p[0] if isinstance(p, tuple) else (p + 2**63) % 2**64 - 2**63)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed


def plain_sketch(text):
    out, words = [], bag(text)
    for k in range(SAMPLES):
        j, i = divmod(k, CHUNK)
        best = None
        for word, w in words.items():
            base = h64(42, h64(42, (12,), word.encode()), (j,))
            a, c = (h64(42, base, (2 * i + n,)) for n in range(2))
            low = (1 << 22) - 1
            r = -math.log(((a >> 42) + 0.5) / 2**22 * (((a >> 20 & low) + 0.5) / 2**22))
            ln_c = math.log(-math.log(((c >> 32) + 0.5) / 2**32 * (((c & 0xFFFFFFFF) + 0.5) / 2**32)))
            beta = ((a & (1 << 20) - 1) + 0.5) / 2**20
            t = math.floor(math.log(w) / r + beta)
            value = int((ln_c - r * (t - beta) - r + 256) * 2**30)
            mark = (base >> 5 * i ^ t) & 0xFFFFFF
            best = min(best or (value, mark), (value, mark))
        out.append(best[1])
    return out


def plain_edit(texts):
    out = []
    for i, t in enumerate(texts):
        m = len(t) // 4
        out.append(t[:len(t) - m] + texts[(i + 1) % len(texts)][:m])
    return out


def hexed(marks):
    return "".join(f"{m:06x}" for m in marks)


def test_query_equals_plain_draws(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    texts = [t for _, t in docs]
    edited = plain_edit(texts)
    got = {r["doc_id"]: r for r in op12_cws(spark, SF).collect()}
    assert len(got) == len(docs)
    few = sorted(range(len(docs)), key=lambda i: len(texts[i]))[:40]
    for i, (d, t) in enumerate(docs):
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited[i].encode()).hexdigest())
        after = got[docs[(i + 1) % len(docs)][0]]["fingerprint"]
        own = [r["fingerprint"][k:k + 6] for k in range(0, 6 * SAMPLES, 6)]
        for other, near in ((r["edited_fingerprint"], r["near_edited"]), (after, r["near_next"])):
            assert near == sum(a == other[6 * k:6 * k + 6] for k, a in enumerate(own)) / SAMPLES
        if i in few:
            assert r["fingerprint"] == hexed(plain_sketch(t)) and r["edited_fingerprint"] == hexed(plain_sketch(edited[i]))


def test_collision_rate_is_the_weighted_similarity(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    texts = [t for _, t in docs]
    got = {r["doc_id"]: r for r in op12_cws(spark, "/root/testdata/sf0.01").collect()}
    z = []
    for i, e in enumerate(plain_edit(texts)):
        r = got[docs[i][0]]
        for want, near in ((jaccard(bag(texts[i]), bag(e)), r["near_edited"]), (jaccard(bag(texts[i]), bag(texts[(i + 1) % len(texts)])), r["near_next"])):
            sd = math.sqrt(want * (1 - want) / SAMPLES)
            if sd > 0.02:
                z.append((near - want) / sd)
            elif want in (0, 1):
                assert abs(near - want) < 0.01
    assert len(z) > 900 and abs(sum(z) / len(z)) < 5 / math.sqrt(len(z)) + 0.05
    assert 0.8 < sum(v * v for v in z) / len(z) < 1.2
    by = {}
    for d, t in docs:
        assert by.setdefault(t, got[d]["fingerprint"]) == got[d]["fingerprint"]


def test_weights_count(spark):
    """Weights beyond 1 take part: similarities of bags of the same two words."""
    rows = [(i, " ".join(["a"] * (1 + i) + ["b"] * 5)) for i in range(40)]
    out, name = fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), samples=1024)
    got = {r["doc_id"]: r[name] for r in out.collect()}
    for i in (3, 9, 30):
        for j in (0, 5, 39):
            want = jaccard(bag(rows[i][1]), bag(rows[j][1]))
            near = sum(a == b for a, b in zip(got[i], got[j], strict=True)) / 1024
            assert abs(near - want) < 5 * math.sqrt(want * (1 - want) / 1024) + 1e-9


@pytest.mark.parametrize("per_cut", [1, 7, 10_000])
def test_neighbours_over_cuts(spark, per_cut):
    """Null ids, an id with most rows, gaps: every row meets the next of one order of all rows."""
    rows = [(None, f"n{i}") for i in range(9)] + [(5, f"five {i}") for i in range(60)] + [(i * i, f"t{i} x") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = beside_next(docs, "doc_id", "text", per_cut).filter("ghost = 0").select("cut", "pos", "doc_id", "body", "after").orderBy("cut", "pos").collect()
    assert sorted(r["body"] for r in got) == sorted(t for _, t in rows)
    assert [r["after"] for r in got] == [r["body"] for r in got[1:]] + [got[0]["body"]]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids)
    if per_cut == 1:  # neither the nulls nor the hot id stay together
        by_cut = Counter(r["cut"] for r in got)
        assert max(by_cut.values()) < 25 and len(by_cut) > 30


def test_odd_rows(spark, empty_docs):
    long = "word " * 60_000 + "end"
    rows = [(None, None), (None, ""), (1, "   \n"), (2, "A"), (2, "a"), (3, "abc"), (4, "x" * 100_000), (5, long), (6, "abcd"), (7, "ÀB ç\U0001F600 d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS cut", "2 AS Fingerprint", "'z' AS s0")
    got = compare_edited(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_chars"]) for r in got) == sorted((i is None, i or 0, len(t or "")) for i, t in rows)
    by = {(r["doc_id"], r["n_chars"]): r for r in got}
    assert by[(3, 3)]["near_edited"] == 1.0  # three characters: nothing replaced
    assert by[(6, 4)]["edited_sha256"] == hashlib.sha256("abcÀ".encode()).hexdigest()
    assert by[(1, 4)]["fingerprint"] == by[(None, 0)]["fingerprint"]  # no words
    assert compare_edited(empty_docs).count() == 0
    one = compare_edited(spark.createDataFrame([(9, "one two three four")], "doc_id long, text string")).collect()
    assert [r["near_next"] for r in one] == [1.0]  # a lone document is its own next
    out, name = fingerprints(docs)
    assert name != "Fingerprint" and out.columns == [*docs.columns, name] and out.count() == len(rows)
    two = {r["text"]: r[name] for r in out.collect()}
    assert two["A"] == two["a"] and fingerprints(empty_docs)[0].count() == 0
    assert out.select(likeness(out[name], out[name]).alias("n")).distinct().collect()[0]["n"] == 1.0
