"""Quoted cells over line ends, read in splits; rows that do not fit."""

import csv
import random

import pytest

from tableprep.sources.csv import read_csv
from tableprep.sources.csv_records import scan


@pytest.fixture
def splits(spark):
    """Reads files in splits of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def use(size):
        for n, v in zip(names, (size, 0), strict=True):
            spark.conf.set(n, v)
    yield use
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


def random_rows(n, seed, sep):
    rng = random.Random(seed)
    bits = ["a", "bc", '"', sep, "\n", "\r\n", " ", "é", '""', "\n\n", "end", "7"]
    return [[str(i), "".join(rng.choice(bits) for _ in range(rng.randint(0, 25))), 'x"y' if i % 7 == 0 else "plain",
             "".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))] for i in range(n)]


@pytest.mark.parametrize("sep,end,size", [(",", "\n", 2000), (";", "\r\n", 150), ("\t", "\n", 40)])
def test_random_cells_in_many_splits(spark, splits, tmp_path, sep, end, size):
    rows = random_rows(400, 3, sep)
    for name, part in (("one.csv", rows[:250]), ("two.csv", rows[250:])):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, delimiter=sep, lineterminator=end)
            w.writerows([["i", "text", "e", "last\ncolumn"], *part])
    splits(size)
    got = read_csv(spark, str(tmp_path), sep=sep, typed=False)
    assert got.columns == ["i", "text", "e", "last\ncolumn"]
    assert got.rdd.getNumPartitions() > 5
    assert sorted(map(tuple, got.collect())) == sorted((r[0], r[1] or None, *r[2:]) for r in rows)
    kinds = read_csv(spark, str(tmp_path), sep=sep, schema="i int, text string, e string, z string", columns=["text", "i"])
    assert sorted(map(tuple, kinds.collect()), key=str) == sorted(((r[1] or None, int(r[0])) for r in rows), key=str)


def test_one_cell_over_many_splits(spark, splits, tmp_path):
    text = "\n".join(f'line {i}, "{i}"' for i in range(300))
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows([["k", "t"], ["1", "x"], ["2", text], ["3", ""], ["4", "y\n"]])
    splits(100)
    got = read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(map(tuple, got.collect())) == [(1.0, "x"), (2.0, text), (3.0, None), (4.0, "y\n")]


@pytest.mark.parametrize("multiline", [True, False])
@pytest.mark.parametrize("row", ["3,4,,lost", "3,4,", "3,4,5", '3,"4",,,"x"', "3,4,,,,,"])
def test_surplus_cells_are_an_error(spark, tmp_path, row, multiline):
    (tmp_path / "a.csv").write_text(f"a,b\n1,2\n{row}\n")
    for options in ({}, {"schema": "a string, b string"}, {"columns": ["a"], "typed": False}):
        with pytest.raises(Exception, match="more cells than the header"):
            read_csv(spark, str(tmp_path / "a.csv"), multiline=multiline, **options).collect()


def test_malformed_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"never\nclosed\n2,3\n')
    with pytest.raises(Exception, match="never ends"):
        read_csv(spark, str(tmp_path / "a.csv")).collect()
    folder = tmp_path / "two"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b\n1,2\n")
    (folder / "b.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(Exception, match="does not have [23] cells"):
        read_csv(spark, str(folder)).collect()


def test_short_rows_blank_lines_and_stray_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\n\na,b,c\n1\n\n2,5" pipe,"x"y\n\n3,,"q, ""r"""\n4,"","z"')
    got = read_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(map(tuple, got.select("a", "b").collect())) == [(1.0, None), (2.0, '5" pipe'), (3.0, None), (4.0, None)]
    assert {r["a"]: r["c"] for r in got.filter("a <> 2").collect()} == {1.0: None, 3.0: 'q, "r"', 4.0: "z"}
    (tmp_path / "mac.csv").write_bytes(b'a,b\r1,"x\ny"\r2,z')
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "mac.csv"), line_end="\r", schema="a int, b string").collect())) == [(1, "x\ny"), (2, "z")]


def test_scan_agrees_with_a_character_machine():
    rng = random.Random(8)

    def plain(line, inside):
        seps, i, start = 0, 0, True
        while i < len(line):
            c = line[i]
            if inside:
                if c == '"':
                    if line[i + 1:i + 2] == '"':
                        i += 1
                    else:
                        inside, start = False, False
            elif c == '"' and start:
                inside = True
            elif c == ",":
                seps, start = seps + 1, True
            else:
                start = False
            i += 1
        return inside, seps
    for _ in range(5000):
        line = "".join(rng.choice('a",') for _ in range(rng.randint(0, 12)))
        for inside in (False, True):
            assert scan(line.encode(), b",", inside) == plain(line, inside), (line, inside)


def test_lines_of_crossing_records_are_cut_once(spark, splits, tmp_path):
    """The typing pass and the result read the stored records; the text files are not cut again for them."""
    text = "\n".join(f"w{i}" for i in range(400))
    with open(tmp_path / "a.csv", "w", newline="") as f:
        csv.writer(f).writerows([["k", "t"], *[[str(i), text + '"'] for i in range(4)]])
    splits(3000)
    got = read_csv(spark, str(tmp_path / "a.csv"))
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(float(i), text + '"') for i in range(4)]
