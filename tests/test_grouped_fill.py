"""Text fills of large groups carry positions, not texts."""

import random

import pytest

from tableprep.operators.fill import directional_fill


def carried(values, forward):
    out, last = [], None
    for v in values if forward else reversed(values):
        last = v if v is not None else last
        out.append(last)
    return out if forward else out[::-1]


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("grouped", [True, False])
def test_text_fill_in_ranges(spark, forward, grouped):
    """One group holds half of the rows, one key is missing, runs of missing values cross several ranges."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        g = "hot" if i % 2 else rng.choice(["a", "b", None])
        rows.append((i, g, f"text {i} " * 5 if rng.random() < 0.03 else None, float(i) if rng.random() < 0.2 else None, f"s{i}" if i > 700 else None))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "i int, g string, t string, x double, late string").repartition(5)
    out = directional_fill(df, ["t", "x", "late"], "i", ["g"] if grouped else (), forward, ranges=16)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: (r["t"], r["x"], r["late"]) for r in out.collect()}
    assert len(got) == 900 and out.columns == df.columns
    groups = {}
    for r in sorted(rows):
        groups.setdefault(r[1] if grouped else 0, []).append(r)
    for members in groups.values():
        cols = [carried([r[k] for r in members], forward) for k in (2, 3, 4)]
        for r, *want in zip(members, *cols):
            assert got[r[0]] == tuple(want)


@pytest.mark.parametrize("part, ranges", [([], None), ([], 3), (["g"], None), (["g"], 3)])
@pytest.mark.parametrize("cols", [["x"], ["x", "s"]])
def test_backward_fill_has_no_quadratic_frame(spark, part, ranges, cols):
    """A frame up to the last row is evaluated anew for every row: the order is reversed instead."""
    rows = [(i, i % 3, float(i) if i % 7 == 0 else None, f"t{i}" if i % 11 == 0 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, g int, x double, s string")
    out = directional_fill(df, cols, "k", part, forward=False, ranges=ranges)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    got = {r["k"]: r for r in out.collect()}
    for at, c in ((2, "x"), (3, "s")):
        for k, g, *_ in rows:
            later = [r[at] for r in rows[k:] if r[at] is not None and (not part or r[1] == g)]
            want = (later[0] if later else None) if c in cols else rows[k][at]
            assert got[k][c] == want
