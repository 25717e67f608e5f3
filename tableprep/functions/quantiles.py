"""Exact quantiles without a one-task sort: radix selection.

Spark's exact ``percentile`` keeps a value->count map per group and merges all
partial maps in one task: memory grows with the number of distinct values.
Here each wanted order statistic is found digit by digit, for all columns and
ranks at once:

1. a *cell* is a range of one column, identified by a chain of digits; the
   first cell of a column is [min, max] (the caller's own aggregate usually has
   min, max and count already);
2. ONE scan a round counts (count, min, max) per (cell, digit) with map-side
   combining. A digit is 12 bits of the value: of its place in the cell if the
   cell spans less than 12 powers of two (4096 equal steps), else its sign and
   power of two. Both rise with the value, so ranks stay exact: the digit that
   holds a wanted rank is the next cell. Its min and max are the cell's new
   ends, and a digit of one value answers at once (a hot value never needs more
   work);
3. a cell of one power of two holds 52 bits of values, so six rounds settle
   every rank, however the values are spread (one for the power, five of 12
   bits). Cells of at most ``local_rows`` values are ranked earlier, by a window
   partitioned by cell, fed by ONE scan.

One row per wanted rank and round reaches the driver. Results use linear
interpolation between the two neighbouring order statistics (pandas /
``percentile`` / DuckDB ``quantile_cont``).
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..names import qcol

BUCKETS = 4096
INF = float("inf")
#: Rounds within which every cell is one value: a power of two, then 52 bits by 12, and one in hand for rounding.
ROUNDS = 7


def _split(lo: float, hi: float, nb: int) -> tuple[float, float] | None:
    """(first, step) of ``nb`` equal steps of a cell; None if it is to be split by powers of two.

    A step of 0: the cell is so narrow that its values are told apart as they are.
    """
    small, large = sorted((abs(lo), abs(hi)))
    if lo < 0 < hi or large == INF or large > small * max(nb, 8):
        return None
    return lo, (hi - lo) / nb


def _digit(nb: int):
    """The digit of ``v`` in a cell split as ``first`` and ``step`` say (a step below 0: by sign and power of two)."""
    v, first, step = F.col("v"), F.col("first"), F.col("step")
    equal = F.least(F.lit(nb - 1.0), F.floor((v - first) / step).cast("double"))
    # 1074 powers below 1, 1024 above; infinity has its own
    power = F.lit(1100) + F.floor(F.greatest(F.lit(-1075.0), F.least(F.lit(1024.0), F.log2(F.abs(v)))))
    return (F.when(step > 0, equal).when(step == 0, v)
            .otherwise(F.when(v == 0, F.lit(0)).otherwise(F.when(v > 0, power).otherwise(-power)).cast("double")))


def _table(spark, rows: list[tuple], fields: str):
    """A small constant table (doubles as text, so that infinities pass)."""
    names = [f.split()[0] for f in fields.split(", ")]
    text = json.dumps([{n: None if x is None else str(x) for n, x in zip(names, r)} for r in rows])
    kind = ", ".join(f"{n}: string" for n in names)
    out = spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))
    return out.select(*[F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in fields.split(", ")])


class _Cells:
    """The cells of a search: a tree of digits under one root a column.

    Which cell a value lies in is looked up level by level, by broadcast joins
    with small tables, so that the generated code does not grow with the cells.
    """

    def __init__(self, src: DataFrame, cols: list[str], buckets: int):
        self.src, self.cols, self.buckets = src, cols, buckets
        self.parent: list[tuple[int, float] | None] = [None] * len(cols)   # of each cell: (parent, digit); roots are the columns
        self.how: dict[int, tuple[float, float]] = {}                      # of each cell that was split: (first, step)

    def child(self, cell: int, digit: float) -> int:
        self.parent.append((cell, digit))
        return len(self.parent) - 1

    def path(self, cell: int) -> list[int]:
        out = [cell]
        while self.parent[out[-1]] is not None:
            out.append(self.parent[out[-1]][0])
        return out[::-1]

    def rows(self, wanted: set[int]) -> DataFrame:
        """``(cell, v, first, step)`` of the values in the wanted cells, none of which lies in another; ONE scan."""
        spark, paths = self.src.sparkSession, [self.path(x) for x in sorted(wanted)]
        roots = sorted({p[0] for p in paths})
        both = self.src.select(F.inline(F.array(*[F.struct(F.lit(r).alias("cell"), qcol(self.cols[r]).alias("v")) for r in roots])))
        both = both.where(F.col("v").isNotNull())
        start = {r: self.how.get(r, (None, None)) for r in roots}
        look = [F.element_at(F.expr(f"array({', '.join(_d(start[r][j]) if r in start and start[r][j] is not None else 'CAST(NULL AS DOUBLE)' for r in range(len(self.cols)))})"),
                             F.col("cell") + 1) for j in (0, 1)]
        cur = both.select("cell", "v", look[0].alias("first"), look[1].alias("step"))
        for level in range(1, max(len(p) for p in paths)):
            nodes = sorted({p[level] for p in paths if len(p) > level})
            table = _table(spark, [(*self.parent[x], x, *self.how.get(x, (None, None))) for x in nodes],
                           "up int, b double, child int, first2 double, step2 double")
            ended = any(len(p) <= level for p in paths)  # some wanted cells lie higher up: their values pass
            inside = F.lit(True)
            if ended:
                inside = ~F.col("cell").isin([p[-1] for p in paths if len(p) <= level])
            cur = cur.withColumn("d", F.when(inside, _digit(self.buckets))).join(
                F.broadcast(table), (F.col("cell") == F.col("up")) & (F.col("d") == F.col("b")), "left" if ended else "inner")
            if ended:
                cur = cur.where(F.col("child").isNotNull() | ~inside)
            cur = cur.select(F.coalesce("child", "cell").alias("cell"), "v", F.col("first2").alias("first"), F.col("step2").alias("step"))
        return cur


def _d(x: float) -> str:
    """Exact double literal."""
    return f"CAST('{float(x)!r}' AS DOUBLE)".replace("'inf'", "'Infinity'").replace("'-inf'", "'-Infinity'")


def minmax_count_aggs(cols, prefix="__qm"):
    """Aggregates whose result :func:`read_minmax_count` turns into ``prefetched``."""
    out = []
    for i, c in enumerate(cols):
        v = qcol(c).cast("double")
        out += [F.count(v).alias(f"{prefix}n{i}"), F.min(v).alias(f"{prefix}a{i}"), F.max(v).alias(f"{prefix}b{i}")]
    return out


def read_minmax_count(row, cols, prefix="__qm"):
    return {c: (int(row[f"{prefix}n{i}"]), row[f"{prefix}a{i}"], row[f"{prefix}b{i}"]) for i, c in enumerate(cols)}


def exact_quantiles(df: DataFrame, spec: dict[str, list[float]], local_rows: int = 20_000,
                    buckets: int = BUCKETS, prefetched: dict | None = None) -> dict[str, list[float | None]]:
    """``prefetched``: {column: (count, min, max)} from the caller's aggregate."""
    cols = list(spec)
    if not cols:
        return {}
    src = df.select(*[qcol(c).cast("double").alias(c) for c in cols])
    if prefetched is None:
        prefetched = read_minmax_count(src.agg(*minmax_count_aggs(cols)).collect()[0], cols)

    found: dict[tuple[str, int], float] = {}
    cells = _Cells(src, cols, buckets)
    # (column, rank) -> (cell, values before the cell, values in it, its min, its max)
    state = {}
    for i, c in enumerate(cols):
        n, mn, mx = prefetched[c]
        for p in spec[c]:
            if n == 0:
                continue
            h = (n - 1) * float(p)
            for k in (int(math.floor(h)), int(math.ceil(h))):
                if mn == mx:
                    found[(c, k)] = mn
                else:
                    state[(c, k)] = (i, 0, n, mn, mx)

    def ranks(keys):
        """What is looked for: (cell, rank in the cell), each once."""
        wanted = sorted({(state[key][0], key[1] - state[key][1]) for key in keys})
        return F.broadcast(_table(df.sparkSession, wanted, "c int, k bigint"))

    rounds = ROUNDS + int(64 / math.log2(buckets))  # fewer steps a round (in tests) take more rounds
    for _ in range(rounds):
        big = {key: st for key, st in state.items() if st[2] > local_rows}
        if not big:
            break
        for cell, _, _, lo, hi in big.values():
            cells.how[cell] = _split(lo, hi, buckets) or (0.0, -1.0)
        counts = (cells.rows({st[0] for st in big.values()}).groupBy("cell", _digit(buckets).alias("b"))
                  .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
        # the digit of each wanted rank is found in Spark: one row per rank comes back
        cum = counts.withColumn("before", F.sum("n").over(Window.partitionBy("cell").orderBy("b")) - F.col("n"))
        hit = cum.join(ranks(big), (F.col("cell") == F.col("c")) & (F.col("k") >= F.col("before"))
                       & (F.col("k") < F.col("before") + F.col("n")))
        rows = {(r["c"], r["k"]): r for r in hit.select("c", "k", "b", "n", "before", "lo", "hi").collect()}
        children: dict[tuple[int, float], int] = {}
        for (c, k), (cell, base, _, _, _) in big.items():
            r = rows[cell, k - base]
            if r["lo"] == r["hi"]:
                found[(c, k)] = r["lo"]
                del state[(c, k)]
            else:
                if (cell, r["b"]) not in children:
                    children[cell, r["b"]] = cells.child(cell, r["b"])
                state[(c, k)] = (children[cell, r["b"]], base + r["before"], r["n"], r["lo"], r["hi"])

    if state:
        order = Window.partitionBy("cell").orderBy("v")
        for st in state.values():
            cells.how.pop(st[0], None)
        ranked = cells.rows({st[0] for st in state.values()}).select("cell", "v", (F.row_number().over(order) - 1).cast("long").alias("r"))
        hit = ranked.join(ranks(state), (F.col("cell") == F.col("c")) & (F.col("r") == F.col("k")))
        got = {(r["c"], r["k"]): r["v"] for r in hit.select("c", "k", "v").collect()}
        for (c, k), (cell, base, _, _, _) in state.items():
            found[(c, k)] = got[cell, k - base]

    out: dict[str, list[float | None]] = {}
    for c in cols:
        n = prefetched[c][0]
        vals = []
        for p in spec[c]:
            if n == 0:
                vals.append(None)
                continue
            h = (n - 1) * float(p)
            lo_k, hi_k = int(math.floor(h)), int(math.ceil(h))
            a, b = found[(c, lo_k)], found[(c, hi_k)]
            vals.append(a if lo_k == hi_k else a + (h - lo_k) * (b - a))
        out[c] = vals
    return out
