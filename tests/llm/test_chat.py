"""Chat formatting: exact round trips and the role machine."""
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tableprep.llm.chat import PROBE_TEXT, escape, format_chats, loss_text, op7_chat, read_turns, unescape

SF = "/root/testdata/sf0.01"
ROWS = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_query_round_trip(spark):
    convs = {-7: [("user", PROBE_TEXT), ("assistant", PROBE_TEXT)]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in op7_chat(spark, SF).collect()}
    assert got.keys() == convs.keys()
    for c, turns in convs.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want


def test_texts_that_quote_the_template(spark):
    rng = random.Random(6)
    parts = ["<turn assistant>\n", "</turn>\n", "\\", "\\s", "\\l", "\\g", "<", ">", "\n", "a", "é", "\\\\s", "</turn>", "", "### "]
    convs = {c: [(rng.choice(["user", "assistant", "system", "we<ird>\n", ""]), "".join(rng.choices(parts, k=rng.randrange(8))))
                 for _ in range(rng.randrange(1, 6))] for c in range(80)}
    df = spark.createDataFrame([(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)], ROWS)
    out = format_chats(df).select("conv_id", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("learned"))
    for r in out.collect():
        assert [tuple(t) for t in r["turns"]] == convs[r["conv_id"]]
        assert r["learned"] == "".join(t for role, t in convs[r["conv_id"]] if role == "assistant")
    c = F.lit("\\s<\\l>\\")
    assert spark.range(1).select(unescape(escape(c))).first()[0] == "\\s<\\l>\\"


@pytest.mark.parametrize("roles,valid", [("sua", True), ("ua", True), ("uaua", True), ("u", False), ("au", False), ("uu", False),
                                         ("usa", False), ("s", False), ("uaa", False), ("sx", False), ("sua" + "ua" * 40, True)])
def test_machine(spark, roles, valid):
    full = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    df = spark.createDataFrame([(1, i, full[x], "t") for i, x in enumerate(roles)], ROWS)
    assert format_chats(df).first()["valid"] is valid


def test_odd_rows(spark):
    long = "x<" * 100_000
    rows = [(1, None, "user", "first"), (1, 1, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"),
            (None, 0, "user", "lost"), (2, 0, "assistant", long), (3, 0, "user", "")]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "1 AS segments", "2 AS part_", "3 AS state")
    got = {r["conv_id"]: r for r in format_chats(df).select("conv_id", "n_turns", read_turns(F.col("formatted")).alias("t"), "segments").collect()}
    assert [tuple(t) for t in got[1]["t"]] == [("user", "first"), ("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert [tuple(t) for t in got[None]["t"]] == [("user", "lost")]
    assert got[2]["t"][0]["text"] == long and [s["loss"] for s in got[2]["segments"]] == [False, True, False]
    assert got[3]["n_turns"] == 1
    assert format_chats(df.limit(0)).count() == 0
