"""Records of CSV files whose quoted cells may hold line ends, from splits read apart.

Spark's text source splits a file at line ends wherever they stand. Whether a
line begins inside a quoted cell depends on all lines before it, so a first
pass works out, for each split, in which state it ends under both states it
might begin in; going through the splits in order fixes the true states. The
second pass cuts each split at its real record ends. A record that crosses
splits comes out in pieces, which are put together afterwards: at most two
pieces a split. The second pass is stored when there are pieces, so that lines are read
twice however often the records are; Python looks at the lines with quotes only.

A quote opens a cell only at its beginning; inside, two quotes are one and a
single one closes it; elsewhere a quote is an ordinary character.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.store import stored

# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QUOTE = b'"'
OPEN = -1  # cells of a record that never ends
_LINES = "file long, split long, line binary"


def scan(line: bytes, sep: bytes, inside: bool) -> tuple[bool, int]:
    """Whether the line ends inside a quoted cell, and the separators outside of quotes."""
    seps, at_start, closed = 0, True, False
    parts = line.split(QUOTE)
    last = len(parts) - 1
    for i, text in enumerate(parts):
        if inside:
            if i == last:
                return True, seps
            inside, closed = False, True
            continue
        if closed and not text and i < last:
            inside, closed = True, False  # two quotes inside a cell
            continue
        seps += text.count(sep)
        at_start = text.endswith(sep) if text else at_start and not closed
        closed = False
        if i < last:
            inside, at_start = at_start, False
    return False, seps


def _runs(batch: pa.RecordBatch):
    """Parts of a batch of lines that belong to one split: (file, split, lines)."""
    file, split = (batch.column(i).to_numpy() for i in (0, 1))
    edges = np.flatnonzero((file[1:] != file[:-1]) | (split[1:] != split[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(file)], strict=True):
        if b > a:
            yield int(file[a]), int(split[a]), batch.column(2).slice(a, b - a)


def _lines(spark: SparkSession, path, line_end: str) -> DataFrame:
    """Lines in the order of their split, with the file (its path hashed) and where the split begins."""
    rows = spark.read.option("lineSep", line_end).text(path)
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
                       F.col("value").cast("binary").alias("line"))


def _states(lines: DataFrame, sep: bytes) -> tuple[dict[int, dict[int, bool]], bool]:
    """file -> split -> whether the split begins inside a quoted cell; and whether any record goes on after its split.

    One row per split comes back: no more than the list of splits that the driver holds for the scan anyway.
    """
    def run(batches):
        ends: dict[tuple[int, int], list[bool]] = {}
        for batch in batches:
            for file, split, rows in _runs(batch):
                state = ends.setdefault((file, split), [False, True])
                for line in rows.filter(pc.match_substring(rows, QUOTE)).to_pylist():
                    if state[0] == state[1]:
                        state[0] = state[1] = scan(line, sep, state[0])[0]
                    else:
                        state[:] = [scan(line, sep, s)[0] for s in state]
        keys = list(ends)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                                          pa.array([ends[k][0] for k in keys], pa.bool_()), pa.array([ends[k][1] for k in keys], pa.bool_())],
                                         ["file", "split", "a", "b"])
    out: dict[int, dict[int, bool]] = {}
    inside = crossing = False
    for file, split, a, b in sorted(tuple(r) for r in lines.mapInArrow(run, "file long, split long, a boolean, b boolean").collect()):
        if file not in out:
            inside = False
        out.setdefault(file, {})[split] = inside
        inside = b if inside else a
        crossing |= inside
    return out, crossing


def _record_lines(rows: pa.Array, sep: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Whether a record ends with each line, the separators of each line outside of quotes, and the state after the last."""
    at = np.flatnonzero(pc.match_substring(rows, QUOTE).to_numpy(zero_copy_only=False))
    seps = pc.count_substring(rows, sep).to_numpy(zero_copy_only=False).astype(np.int64)
    after, found = np.empty(len(at) + 1, dtype=bool), np.empty(len(at), dtype=np.int64)
    after[0] = inside
    for k, line in enumerate(rows.take(pa.array(at)).to_pylist()):
        inside, found[k] = scan(line, sep, inside)
        after[k + 1] = inside
    open_after = np.repeat(after, np.diff([0, *at.tolist(), len(rows)]))  # a line without quotes leaves the state as it is
    seps[open_after] = 0
    seps[at] = found
    return ~open_after, seps, inside


def _cut(lines: DataFrame, sep: bytes, states: dict[int, dict[int, bool]] | None) -> DataFrame:
    """Records and pieces of records: ``(file, split, part, done, line, cells, head)``.

    Whole records of a split have no ``part``; ``head`` marks the first of its file. Of pieces, part 0 goes on with a
    record from an earlier split, part 1 begins one; ``done`` where it ends. Without ``states`` every line is a record.
    """
    shared = lines.sparkSession.sparkContext.broadcast(states)

    def run(batches):
        states = shared.value
        here, inside, first, held, cells, top = None, False, False, [], 0, False

        def rows_of(of, part, done, texts, counts, head=None):
            n = len(texts)
            same = lambda x, kind: pa.array([x] * n, kind)
            return pa.RecordBatch.from_arrays([same(of[0], pa.int64()), same(of[1], pa.int64()), same(part, pa.int32()), same(done, pa.bool_()),
                                               texts, pa.array(counts, pa.int32()), same(False, pa.bool_()) if head is None else head],
                                              ["file", "split", "part", "done", "line", "cells", "head"])

        def piece(part, done):
            return rows_of(here, part, done, pa.array([b"\n".join(held)], pa.binary()), [cells])

        def heads(texts):
            """Marks the first line with a text, if it is the first of its file."""
            nonlocal top
            out = np.zeros(len(texts), dtype=bool)
            if top:
                at = next((i for i, x in enumerate(texts) if x.as_py().strip()), None)
                if at is not None:
                    out[at], top = True, False
            return pa.array(out)

        for batch in batches:
            for file, split, rows in _runs(batch):
                if (file, split) != here:
                    if held:  # the split's last record goes on in the next split
                        yield piece(0 if first else 1, False)
                    here, held, cells, top = (file, split), [], 0, split == 0
                    if states is not None and split not in states.get(file, ()):
                        raise RuntimeError("read_csv: the files are split otherwise than when they were first read; read them again")
                    inside = first = states is not None and states[file][split]
                if states is None:
                    seps = pc.count_substring(rows, sep).to_numpy(zero_copy_only=False).astype(np.int64)
                    at = np.flatnonzero(pc.match_substring(rows, QUOTE).to_numpy(zero_copy_only=False))
                    seps[at] = [scan(x, sep, False)[1] for x in rows.take(pa.array(at)).to_pylist()]
                    yield rows_of(here, None, True, rows, seps + 1, heads(rows))
                    continue
                ends, seps, inside = _record_lines(rows, sep, inside)
                edges = np.flatnonzero(ends) + 1
                begin = 0
                if held or first:  # the record that is open ends here, or goes on
                    begin = int(edges[0]) if len(edges) else len(rows)
                    held += rows.slice(0, begin).to_pylist()
                    cells += int(seps[:begin].sum())
                    if not len(edges):
                        continue
                    if first:
                        yield piece(0, True)
                    else:
                        text = pa.array([b"\n".join(held)], pa.binary())
                        yield rows_of(here, None, True, text, [cells + 1], heads(text))
                    first, held, cells, edges = False, [], 0, edges[1:]
                if len(edges):
                    bounds = np.concatenate([[begin], edges])
                    part = rows.slice(begin, int(edges[-1]) - begin)
                    if len(edges) == len(part):
                        texts = part  # a line each
                    else:
                        lists = pa.ListArray.from_arrays(pa.array(bounds - begin, pa.int32()), pa.concat_arrays([part]))
                        texts = pc.binary_join(lists, pa.scalar(b"\n", pa.binary()))
                    yield rows_of(here, None, True, texts, np.add.reduceat(seps[begin:edges[-1]], bounds[:-1] - begin) + 1, heads(texts))
                    begin = int(edges[-1])
                if begin < len(rows):
                    held = rows.slice(begin).to_pylist()
                    cells = int(seps[begin:].sum())
        if held:
            yield piece(0 if first else 1, False)
    return lines.mapInArrow(run, "file long, split long, part int, done boolean, line binary, cells int, head boolean")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records from their pieces; one without an end gets ``OPEN`` cells."""
    order = W.partitionBy("file").orderBy("split", "part")
    pieces = pieces.withColumn("begin", F.max(F.when(F.col("part") == 1, F.col("split"))).over(order))
    whole = pieces.groupBy("file", "begin").agg(
        F.array_sort(F.collect_list(F.struct("split", "part", F.col("line").cast("string").alias("line")))).alias("p"),
        F.sum("cells").alias("n"), F.max("done").alias("done"))
    return whole.select(F.array_join("p.line", "\n").cast("binary").alias("line"),
                        F.when(F.col("done"), F.col("n") + 1).otherwise(OPEN).cast("int").alias("cells"), F.lit(False).alias("head"))


def records(spark: SparkSession, path, sep: str, multiline: bool = True, line_end: str = "\n") -> DataFrame:
    """``(record string, cells int, head boolean)``: all records of the files; empty lines are left out.

    ``cells`` is the number of cells, -1 for a record whose quoted cell never ends; ``head`` marks the first record of
    each file. A carriage return before the line end of a record is not part of it; inside a quoted cell it stays. With
    ``multiline=False`` no cell holds a line end, and the pass that looks for them is saved.
    """
    lines, mark = _lines(spark, path, line_end), sep.encode()
    states, crossing = _states(lines, mark) if multiline else (None, False)
    rows = _cut(lines, mark, states)
    if crossing:
        rows = stored(rows)
        rows = rows.filter("part IS NULL").select("line", "cells", "head").unionByName(_joined(rows.filter("part IS NOT NULL")))
    text = F.col("line").cast("string")
    return rows.select(F.when(text.endswith("\r"), F.substring(text, F.lit(1), F.char_length(text) - 1)).otherwise(text).alias("record"),
                       "cells", "head").filter("record <> ''")
