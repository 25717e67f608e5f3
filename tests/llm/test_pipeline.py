"""The pipeline stage by stage against brute force, and the registry."""
import re
from collections import Counter

import corpus_pipeline as P
import pytest
from test_decontam import brute
from test_mixing import plain_mix, words
from test_simhash import plain_components, plain_fingerprint

from tableprep.llm import quality_rules as Q
from tableprep.llm.common import stored

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in P.STAGES:
        docs = stored(f(spark, docs, SF))
        out.append(docs)
    return out


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_stages(spark, outputs):
    assert [n for n, _ in P.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "mix", "shard"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    assert all(o.columns == start.columns for o in outputs[:-1])
    assert outputs[-1].columns == [*start.columns, "shard", "slot"]
    verdict = {r["doc_id"]: r["kept"] for r in Q.op6_quality(spark, SF).collect()}
    kept = rows(outputs[0])
    assert sorted(kept) == sorted(r for r in rows(start) if verdict[r[0]])
    ids = [r[0] for r in kept]
    comp = plain_components(ids, [plain_fingerprint(r[1]) for r in kept])
    unique = rows(outputs[1])
    assert sorted(unique) == sorted(r for r, c in zip(kept, comp) if r[0] == c)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute([r[:2] for r in unique], items)}
    clean = rows(outputs[2])
    assert bad and sorted(clean) == sorted(r for r in unique if r[0] not in bad)
    taken, _, _ = plain_mix(clean)
    mixed = rows(outputs[3])
    got = Counter()
    for r in mixed:
        got[r[0]] += len(words(r[1]))
    assert {d: n for d, n in got.items() if n} == {clean[i][0]: n for i, n in taken.items() if n}
    final = outputs[4].collect()
    assert Counter(tuple(r)[:5] for r in final) == Counter(mixed)
    by = Counter(r["shard"] for r in final)
    assert set(by) <= set(range(16)) and max(by.values()) - min(by.values()) <= 1
    for s, n in by.items():
        assert sorted(r["slot"] for r in final if r["shard"] == s) == list(range(n))


def test_run_is_the_registered_query(spark, outputs):
    import __spark_entry__ as E
    assert P.ORACLE_SQL is None and "pipeline" not in E.oracle_sql()
    out = E.queries()["pipeline"](spark, SF)
    assert Counter(tuple(r)[:5] for r in out.collect()) == Counter(rows(outputs[3]))


def test_every_operator_has_one_query():
    import __spark_entry__ as E
    found = Counter(m[1] for q in E.queries() if (m := re.match(r"op(\d+)_", q)))
    assert found == {str(i): 1 for i in range(1, 14)}


def test_empty_and_odd_documents(spark, empty_docs):
    long = " ".join(f"w{i % 500} {chr(97 + i % 26)}{i % 37}" for i in range(20_000))
    odd = [(1, None, "en", "a", 0), (2, "", None, None, 0), (None, "some words of a text " * 3, "en", "a", 1), (4, long, "en", "b", 2),
           (4, long, "en", "b", 2), (6, "dup", "en", None, None)]
    docs = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (empty_docs, docs):
        cur = start
        for _, f in P.STAGES:
            cur = stored(f(spark, cur, SF))
        assert cur.columns == [*start.columns, "shard", "slot"]
