"""SimHash near-duplicates against brute force over all pairs."""
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tableprep.llm import golay
from tableprep.llm.components import components
from tableprep.llm.simhash import SEGMENTS, fuzzy_keys, keep_first, near_duplicates, near_pairs, op3_simhash

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, most=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    a = np.array(fps, dtype=np.uint64)
    for i in range(len(a)):
        near = np.nonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= most)[0]
        for j in near + i + 1:
            x, y = find(i), find(int(j))
            if x != y:
                root[max(x, y)] = min(x, y)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min(low.get(r, d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_golay_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.uint32)
    counts = np.bincount(golay.indices(words), minlength=1 << 12)
    assert (counts == 1 << 11).all()  # every codeword owns a ball of 1 + 23 + 253 + 1771 words


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in docs]
    want = dict(zip([r["doc_id"] for r in docs], zip([f"{f:016x}" for f in fps], plain_components([r["doc_id"] for r in docs], fps))))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op3_simhash(spark, SF).collect()}
    assert got == want


def test_keys_meet_within_two_bits(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        pairs.append((a, a ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp long").distinct()
    keys = {}
    for r in fuzzy_keys(fps).collect():
        keys.setdefault(r["fp"], set()).add(r["key"])
    assert all(keys[signed(a)] & keys[signed(b)] for a, b in pairs)
    assert sum(b for _, b in SEGMENTS) == 64


def test_links_with_crowded_keys(spark):
    """A ball of near copies far above the pair bound, plus a chain and strays."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    vals = {base ^ 1 << i ^ 1 << j for i in range(40) for j in range(40)}
    chain = [rng.getrandbits(64)]
    for i in range(30):
        chain.append(chain[-1] ^ 1 << i ^ 1 << i + 30)
    vals = sorted(vals | set(chain) | {rng.getrandbits(64) for _ in range(200)})
    signed = [x - (1 << 64) if x >> 63 else x for x in vals]
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = near_pairs(fps)
    assert links.filter("bit_count(a ^ b) > 2").count() == 0
    comp = {r["node"]: r["root"] for r in components(links).collect()}
    got = [comp.get(x, x) for x in signed]
    assert got == plain_components(signed, vals)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000), (7, 6)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark, empty_docs):
    """Null and empty texts link (fingerprint 0); repeated rows and null ids take part; clashing columns stay."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, long, "x"), (5, long.upper(), "x"), (5, long.upper(), "x"),
            (None, long, "x"), (7, "alone here now", "x"), (8, "one", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (None, 4), (7, 7), (8, 8)], key=str)
    kept = keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 7, 8]
    only_null = spark.createDataFrame([(None, "a b c d"), (None, "a b c d")], "doc_id long, text string")
    assert keep_first(only_null).count() == 1
    assert near_duplicates(empty_docs).count() == 0
    assert keep_first(empty_docs).count() == 0
    assert near_duplicates(docs.withColumn("fp_text", F.lit(1))).count() == 9
