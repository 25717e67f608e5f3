"""The language model against brute force: likelihoods, expected counts, unigram base."""
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tableprep.llm import hmm_lm as H
from tableprep.llm.hmm import Packed, expected_counts, first_guess, forward, groups, reestimate

SF = "/root/testdata/sf0.01"


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_query_base_and_counts(spark):
    docs = {r["doc_id"]: tokens(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(t for d, w in docs.items() if not held[d] for t in w)
    n_docs = sum(not h for h in held.values())
    n, v = sum(c.values()) + n_docs, len(c) + 1
    got = H.op2_hmm(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        w = docs[r["doc_id"]]
        base = sum(math.log10((x + 1) / (n + v + 1)) for x in [c[t] for t in w] + [n_docs])
        assert r["held_out"] == held[r["doc_id"]] and r["n_tokens"] == len(w) + 1 and r["train_tokens"] == n
        assert r["n_known"] == sum(c[t] > 0 for t in w) + 1
        assert abs(r["base_score"] - base) < 1e-6 * max(1, abs(base))
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) * 0.95  # clearly better on unseen texts
    assert all(r["score"] < 0 for r in got)


def paths(seq, start, move, emit):
    """All state paths of a sequence with their probabilities."""
    for p in itertools.product(range(len(start)), repeat=len(seq)):
        x = start[p[0]] * emit[seq[0], p[0]]
        for a, b, k in zip(p, p[1:], seq[1:]):
            x *= move[a, b] * emit[k, b]
        yield p, x


def test_forward_and_counts_equal_all_paths():
    rng = np.random.default_rng(1)
    s, k = 3, 5
    start, move = rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s)
    emit = rng.dirichlet(np.ones(k), s).T
    seqs = [rng.integers(0, k, n) for n in (4, 1, 6, 2, 6, 1)]
    flat, offsets = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
    like = forward(Packed(flat, offsets), start, move, emit)
    starts, moves, emits = np.zeros(s), np.zeros((s, s)), np.zeros((k, s))
    for x, got in zip(seqs, like):
        every = list(paths(x.tolist(), start, move, emit))
        total = sum(q for _, q in every)
        assert abs(got - math.log(total)) < 1e-10
        for p, q in every:
            starts[p[0]] += q / total
            for a, b in zip(p, p[1:]):
                moves[a, b] += q / total
            for state, sym in zip(p, x):
                emits[sym, state] += q / total
    for most in (3, 7, 100):
        parts = [expected_counts(g, start, move, emit) for g in groups(flat, offsets, most)]
        assert np.allclose(sum(p[0] for p in parts), starts)
        assert np.allclose(sum(p[1] for p in parts), moves)
        assert np.allclose(sum(p[2] for p in parts), emits)
        assert abs(sum(p[3] for p in parts) - like.sum()) < 1e-9


def test_weights_and_single_precision():
    """A sequence of weight 3 counts as three copies; single precision changes counts by rounding only."""
    rng = np.random.default_rng(6)
    prior = rng.dirichlet(np.ones(40))
    params = first_guess(prior, 5, rng)
    seqs = [rng.integers(0, 40, int(n)) for n in rng.integers(1, 300, 25)]
    weight = rng.integers(1, 5, 25)

    def counts(seqs, weight=None, kind=np.float64):
        flat, offsets = np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(x) for x in seqs])])
        parts = [expected_counts(g, *params, kind) for g in groups(flat, offsets, 700, weight)]
        return [sum(p[i] for p in parts) for i in range(4)]
    want = counts([x for x, w in zip(seqs, weight) for _ in range(w)])
    for got, tol in ((counts(seqs, weight), 1e-9), (counts(seqs, weight, np.float32), 1e-4)):
        assert all(np.allclose(a, b, rtol=tol) for a, b in zip(got, want))


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(2)
    flat = np.concatenate([rng.integers(0, 10, 400), rng.integers(10, 20, 400)])
    offsets = np.arange(0, 801, 20)
    prior = np.full(20, 0.05)
    params, last = first_guess(prior, 2, rng), -np.inf
    for _ in range(12):
        parts = [expected_counts(g, *params) for g in groups(flat, offsets, 150)]
        like = sum(p[3] for p in parts)
        assert like > last - 5
        last = like
        params = reestimate(*(sum(p[i] for p in parts) for i in range(3)), prior, 1e-9)
    assert like > 800 * math.log(0.05) + 300  # two kinds of sequences, found


def test_spark_round_equals_one_process(spark):
    rng = np.random.default_rng(3)
    prior = rng.dirichlet(np.ones(30))
    params = first_guess(prior, 4, rng)
    seqs = [rng.integers(0, 30, int(n)).astype(np.uint16) for n in rng.integers(1, 40, 60)]
    df = spark.createDataFrame([(bytearray(x.tobytes()),) for x in seqs], "classes binary").repartition(5)
    got = H.baum_welch(df, params, prior, 3.0)
    p = Packed(np.concatenate(seqs), np.concatenate([[0], np.cumsum([len(x) for x in seqs])]))
    want = reestimate(*expected_counts(p, *params)[:3], prior, 3.0)
    assert all(np.allclose(a, b, rtol=1e-4) for a, b in zip(got, want))


def test_training_goes_on_until_the_likelihood_settles(spark):
    """Long texts alone: another round over all of them gains less than the tolerance."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(12):  # two hidden states that stay, each with words of its own and some shared
        state, words = 0, []
        for _ in range(2_500):
            state ^= int(rng.random() < 0.1)
            words.append("w%d" % (rng.integers(0, 12) + 8 * state))
        rows.append((i, False, bytearray(" ".join(words).encode())))
    texts = spark.createDataFrame(rows, "doc_id long, held_out boolean, text binary").repartition(3)
    counts = H.stored(H.word_counts(texts.select("text")), 1)
    vocab, *_ = H.build_vocabulary(counts, len(rows))
    enc = H.stored(H.encode(texts, vocab).withColumn("row", F.monotonically_increasing_id()), 1)
    like = lambda p: H._forward_scores(enc, p, vocab, ["row"]).agg(F.sum("path")).first()[0] / (12 * 2_501)
    got = H.train(enc, vocab, 2)
    assert like(H.baum_welch(enc, got, vocab.prior)) - like(got) < 0.001


def test_probabilities_add_up(spark, monkeypatch):
    """Over all words there are, and one that is not, the model's first step adds up to one."""
    monkeypatch.setattr(H, "OWN_CLASS", 3)
    monkeypatch.setattr(H, "DICTIONARY", 8)
    monkeypatch.setattr(H, "BUCKETS", 4)
    words = [f"w{i}" for i in range(20)]
    text = " ".join(w for i, w in enumerate(words) for _ in range(1 + i % 5))
    # one-word texts; unseen words, one for each bucket
    unseen = {}
    for i in range(1000):
        unseen.setdefault(H.bucket(f"zz{i}".encode()), f"zz{i}")
    assert len(unseen) == 4
    rows = [(0, text), (1, text)] + [(10 + i, w) for i, w in enumerate(words)] + [(100 + b, w) for b, w in unseen.items()] + [(500, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in H.score_texts(docs, held=docs["doc_id"] >= 10, states=2, rounds=1).collect()}
    assert all(got[10 + i]["n_known"] == 2 for i in range(20)) and all(got[100 + b]["n_known"] == 1 for b in unseen)
    # with one state the steps are independent: P(word) = P(word, end) / P(end)
    one = {r["doc_id"]: r["score"] for r in H.score_texts(docs, held=docs["doc_id"] >= 10, states=1, rounds=1).collect()}
    end = 10 ** one[500]
    total = end + sum(10 ** (one[d] - one[500]) for d in one if 10 <= d < 500)
    assert abs(total - 1) < 1e-9


def test_counts_and_codes_equal_plain_python(spark):
    """Bytes of all kinds (NUL, control and other white space, long words) in the vectorised paths."""
    rng = np.random.default_rng(9)
    bits = ["a", "B", "é", "Z9", "\x00", "\x01", "\x0b", " ", "\n", "\x1f", "\u2003", "long" * 30, "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.integers(0, 60))) for _ in range(300)]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "i int, text binary").repartition(3)
    space = lambda w: w.replace("\x00", " ").encode()  # NUL takes the place of the space
    want = Counter(space(w) for t in texts for w in tokens(t))
    got = {bytes(r["token"]): r["c"] for r in H.word_counts(df.select("text")).collect()}
    assert got == want
    words = sorted(want, key=lambda w: (-want[w], w))[:40]
    vocab = H.Vocabulary(words, np.array([want[w] for w in words]), np.zeros(H.BUCKETS), 7)
    cls = {w: int(c) for w, c in zip(words, vocab.classes)}
    for r in H.encode(df, vocab).collect():
        w = [space(x) for x in tokens(texts[r["i"]])]
        assert np.frombuffer(r["classes"], dtype=np.uint16).tolist() == [cls.get(x, vocab.first_bucket + H.bucket(x)) for x in w] + [0]
        assert (r["n_tokens"], r["known"]) == (len(w) + 1, sum(x in cls for x in w) + 1)
        assert math.isclose(r["logs"], sum(math.log10(want[x] + 1) for x in w if x in cls) + math.log10(8))
        assert Counter(dict(zip(map(bytes, r["rare"]), r["rare_n"]))) == Counter(x for x in w if x not in cls)


def test_odd_rows(spark, empty_docs):
    long = " ".join(f"t{i % 3000}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Hello HELLO hello"), (4, "Hello HELLO hello"), (None, "never seen"),
            (6, "y" * 50_000), (7, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS known", "3 AS classes")
    got = H.score_texts(docs, held=docs["doc_id"].isNull()).collect()
    assert len(got) == len(rows) and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["n_tokens"] for i in (1, 2, 3, 4, None, 6, 7)] == [1, 1, 1, 4, 3, 2, 30_001]
    assert by[None]["n_known"] == 1 and by[6]["n_known"] == 2 and by[1]["score"] == by[2]["score"] == by[3]["score"]
    assert H.score_texts(empty_docs).count() == 0
    none = H.score_texts(docs.limit(2), held=docs["doc_id"] > 0).collect()  # nothing to learn from
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in none)
