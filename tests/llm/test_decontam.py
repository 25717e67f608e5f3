"""Benchmark decontamination against brute force over all windows."""
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tableprep.llm.decontam import drop_leaks, find_leaks, op4_decontam
from tableprep.llm.textblock import Words, byte_map, slices

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x09-\x0d -/:-@\[-`{-~]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(w, k=5):
    return Counter(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()


def brute(docs, items, least=0.8):
    """Best similarity of every (document, item) over all item-sized windows."""
    out = {}
    prepared = [(i, words_of(t)) for i, t in items]
    for d, t in docs:
        w = words_of(t)
        grams = set(bag(w))
        for i, iw in prepared:
            if not iw or (len(iw) >= 5 and not grams & set(bag(iw))):
                continue
            want = bag(iw)
            n = len(iw)
            if n < 5 and len(w) < n:
                continue
            best = 0
            for s in range(max(1, len(w) - n + 1)):
                got = bag(w[s:s + n], min(5, n))
                best = max(best, (got & want).total() / max(1, (got | want).total()))
            if best >= least:
                out[d, i] = round(best, 9)
    return out


def run(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in find_leaks(d, b, **kw).collect()}


def test_words_and_hashes():
    rng = random.Random(3)
    texts = ["", "a", " a", "a ", "ab cd", "x" * 100 + " y", "été, déjà!", "A-b_C", "\x00z\x00", None, "same same Same"]
    texts += ["".join(rng.choice("ab,. \n\tÄé") for _ in range(rng.randrange(40))) for _ in range(200)]
    col = pa.array([None if t is None else t.encode() for t in texts], pa.binary()).fill_null(b"")
    for table, pattern, lower in ((byte_map(lower=True, punctuation=True), None, None), (byte_map(lower=False), r"[^\x20\x09-\x0d]+", False)):
        seen, at = {}, 0
        for row, n, data, offsets in slices(col, 64):
            w = Words(data, offsets, table)
            for d in range(n):
                got = [bytes(data[a:b]) for a, b in zip(w.start[w.first[d]:w.first[d + 1]], w.end[w.first[d]:w.first[d + 1]])]
                want = words_of(texts[row + d]) if pattern is None else re.findall(pattern, texts[row + d] or "")
                assert [g.decode().lower() if pattern is None else g.decode() for g in got] == [x.lower() if pattern is None else x for x in want]
                for x, h in zip(want, w.hash[w.first[d]:w.first[d + 1]].tolist()):
                    assert seen.setdefault(x, h) == h
            at += n
        assert at == len(texts) and len(set(seen.values())) == len(seen)


def test_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in op4_decontam(spark, SF).collect()}
    assert got == brute(docs, items) and got


def test_changed_passages(spark):
    """Edited, moved and cased copies around the threshold; the radius finds what brute force finds."""
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(12, 70)))) for i in range(40)]
    docs = []
    for d in range(160):
        w = items[d % 40][1].split()
        for _ in range(rng.randrange(4)):
            p = rng.randrange(len(w))
            w[p:p + rng.randrange(2)] = [rng.choice(vocab)] * rng.randrange(2)
        if d % 3 == 0:
            w = w[rng.randrange(4):]
        text = " ".join(x.upper() if rng.random() < .2 else x + rng.choice(["", ",", "."]) for x in w)
        around = [" ".join(rng.choices(vocab, k=rng.randrange(30))) for _ in range(2)]
        docs.append((d, f"{around[0]} {text}\n{around[1]}"))
    want = brute(docs, items)
    got = run(spark, docs, items)
    assert got == want and 40 < len(want) < 160
    assert run(spark, docs, items, part_bytes=1500) == want  # the benchmark in several parts


def test_odd_rows(spark, empty_docs):
    item = "one two three four five six seven eight nine ten"
    long = " ".join(f"f{i % 911}" for i in range(50_000))
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, "x " + item.upper()), (5, long + " " + item + " " + long),
            (6, "one two three"), (7, "tiny item"), (8, "a tiny item here")]
    items = [(10, item), (11, item), (12, ""), (13, None), (14, "tiny item"), (15, "!!!")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS similarity")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    got = Counter((r["doc_id"], r["item_id"]) for r in find_leaks(d, b).collect())
    assert got == Counter([(i, j) for i in (3, 3, None, 5) for j in (10, 11)] + [(7, 14), (8, 14)])
    left = drop_leaks(d, b)
    assert left.columns == d.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 6]
    assert find_leaks(empty_docs, b).count() == 0
    assert find_leaks(d, b.limit(0)).count() == 0
    assert drop_leaks(d, b.limit(0)).count() == len(docs)


def test_long_text_block_boundaries():
    """Runs are cut at texts, not inside them."""
    col = pa.array([b"aa bb", b"c" * 500, b"", b"dd"], pa.binary())
    runs = [(i, n) for i, n, _, _ in slices(col, 10)]
    assert runs[0][0] == 0 and sum(n for _, n in runs) == 4
    assert np.all([n >= 1 for _, n in runs])
