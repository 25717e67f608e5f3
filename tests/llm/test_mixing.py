"""Mixing against a plain-Python mix."""
import hashlib
import re
from collections import defaultdict

import pytest

from tableprep.llm.mixing import mix_sources, mixed_documents, op1_mix, source_targets

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, ring=(3, 1, 2)):
    """Share by weight, hold at twice the size, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: ring[i % len(ring)] for i, s in enumerate(names)}
    rest, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s] + 1e-9}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        rest -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return target


def plain_mix(rows):
    """{row index: words taken}"""
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(words(t))
    target = plain_targets(dict(sizes))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    key = lambda r: int(md5(f"mix-1:{'' if r[0] is None else r[0]}:{md5(r[1] or '')}")[:15], 16)
    taken = {}
    for s in sizes:
        mine = sorted((i for i, r in enumerate(rows) if r[3] == s), key=lambda i: (key(rows[i]), rows[i][0] or 0))
        left = int(target[s] + 0.5)
        taken.update({i: 0 for i in mine})
        while left > 0 and sizes[s]:
            for i in mine:
                n = min(left, len(words(rows[i][1])))
                taken[i] += n
                left -= n
    return taken, target, sizes


def test_query_equals_plain_mix(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    taken, target, sizes = plain_mix(rows)
    want = {r[0]: (len(words(r[1])), sizes[r[3]], taken[i]) for i, r in enumerate(rows)}
    got = op1_mix(spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"], r["taken"]) for r in got} == want
    assert all(abs(r["target"] - target[r["source"]]) < 1e-6 for r in got)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-3
    assert max(r["taken"] / r["size"] for r in got if r["size"]) <= 2


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 1000, "c": 5, "d": 7, "e": 10_000}, {"a": 10}, {"a": 0, "b": 10},
    {"a": 0}, {"é": 50, "z": 3, None: 900}, {f"s{i}": 1 + i * i % 97 for i in range(40)}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(frame, (3, 1, 2)).collect()}
    want = plain_targets(sizes)
    assert got.keys() == sizes.keys()
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_weights_by_name(spark):
    frame = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(frame, {"a": 1, "b": 3}, share=(1, 2)).collect()}
    assert got == {"a": 37.5, "b": 112.5, "c": 0.0}


def test_many_cuts_equal_one(spark, monkeypatch):
    rows = [(i, "w " * (i % 7), "en", f"s{i % 3}" if i % 5 else None, 1) for i in range(300)]
    docs = spark.createDataFrame(rows, DOCS)
    one = sorted(mix_sources(docs)[0].select("doc_id", "taken").collect())
    monkeypatch.setattr("tableprep.llm.mixing.cut_step", lambda n: (1 << 60) // 50 + 1)
    assert sorted(mix_sources(docs)[0].select("doc_id", "taken").collect()) == one
    taken, _, _ = plain_mix(rows)
    assert one == sorted((rows[i][0], t) for i, t in taken.items())


def test_odd_rows(spark, empty_docs):
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, "one two", "en", None, 1), (None, "three four five", "en", None, 1),
            (5, long, "en", "b", 1), (6, "dup dup", "en", "a", 1), (6, "dup dup", "en", "a", 1), (8, " \n ", "en", "only empty", 1)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "7 AS size", "'t' AS taken", "1 AS MIX_KEY")
    out, n = mix_sources(docs)
    assert out.columns[:len(docs.columns)] == docs.columns and n["taken"] != "taken"
    got = out.collect()
    assert len(got) == len(rows)
    assert sum(r[n["taken"]] for r in got if r["doc_id"] in (1, 2, 8)) == 0
    for s in ("a", "b", None):
        mine = [r for r in got if r["source"] == s]
        assert sum(r[n["taken"]] for r in mine) == int(mine[0][n["target"]] + 0.5)
    assert mix_sources(empty_docs)[0].count() == 0
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    back = mixed.collect()
    assert sum(len(words(r["text"])) for r in back) == sum(r[n["taken"]] for r in got)
    assert all(r["text"].startswith(r["text"]) for r in back)
    for r in back:  # copies are whole texts or begin one, and n_chars follows a cut
        whole = next(t for i, t, *_ in rows if i == r["doc_id"] and t)
        assert whole.startswith(r["text"])
        assert r["n_chars"] == (1 if r["text"] == whole else len(r["text"]))
    assert mixed_documents(empty_docs).count() == 0
