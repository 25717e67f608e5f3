"""Exact prefix counts and sums of a numeric column, queried many times.

``PrefixIndex(df, column)`` answers ``below(m) -> (count, sum)`` of the
values ``<= m`` (or ``< m``) exactly, from bounded summaries:

* one scan builds an equal-width histogram over [min, max] (count, sum,
  min, max per bucket; map-side combined, at most ``buckets`` groups);
* a query point inside a bucket needs that bucket's detail: a bucket with
  at most ``local_rows`` distinct values is fetched as (value, count) pairs
  (bounded), a larger one is refined into its own histogram (one more scan).
  Details are cached, so repeated queries near the same points cost no job.

Used by 1-D k-means (Lloyd rounds need count and sum below each midpoint).
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..names import qcol


def _bucket(v, lo, w, nb):
    f = F.floor((v - F.lit(lo)) / F.lit(w))
    return F.when(f > F.lit(nb - 1), F.lit(nb - 1)).otherwise(f)


class _Cell:
    def __init__(self, index, chain, lo, hi):
        self.index, self.chain, self.lo, self.hi = index, chain, lo, hi
        self.hist = None      # list of (bucket, n, s, mn, mx) sorted
        self.values = None    # list of (value, n) sorted
        self.children = {}

    def cond(self, v):
        c = v.isNotNull()
        for lo, w, nb, b in self.chain:
            c = c & (_bucket(v, lo, w, nb) == F.lit(b))
        return c

    def load(self, size):
        ix = self.index
        v = qcol(ix.column)
        src = ix.df.where(self.cond(v))
        if size <= ix.local_rows or self.lo == self.hi:
            rows = src.groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()
            self.values = sorted((r["v"], r["n"]) for r in rows)
            self._vals = [x for x, _ in self.values]
            self._cn, self._cs = [0], [0.0]
            for x, n in self.values:
                self._cn.append(self._cn[-1] + n)
                self._cs.append(self._cs[-1] + x * n)
            return
        self.w = (self.hi - self.lo) / ix.buckets
        b = _bucket(v, self.lo, self.w, ix.buckets)
        rows = (src.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"),
                                              F.min(v).alias("mn"), F.max(v).alias("mx")).collect())
        self.hist = sorted((r["b"], r["n"], r["s"], r["mn"], r["mx"]) for r in rows)
        self._mx = [h[4] for h in self.hist]
        self._cn, self._cs = [0], [0.0]
        for _, n, s, _, _ in self.hist:
            self._cn.append(self._cn[-1] + n)
            self._cs.append(self._cs[-1] + s)

    def below(self, m, strict, size):
        """(count, sum) of values < m (strict) or <= m in this cell."""
        if self.hist is None and self.values is None:
            self.load(size)
        if self.values is not None:
            j = (bisect.bisect_left if strict else bisect.bisect_right)(self._vals, m)
            return self._cn[j], self._cs[j]
        # whole buckets below m (bucket maxima increase with the bucket number),
        # plus the detail of the bucket holding m
        j = (bisect.bisect_left if strict else bisect.bisect_right)(self._mx, m)
        if j < len(self.hist):
            b, n, s, mn, mx = self.hist[j]
            if not (mn < m if strict else mn <= m):
                return self._cn[j], self._cs[j]
            child = self.children.get(b)
            if child is None:
                if n <= self.index.local_rows:
                    self._fetch_around(j)
                    child = self.children[b]
                else:
                    child = self.children[b] = _Cell(self.index, self.chain + ((self.lo, self.w, self.index.buckets, b),),
                                                     mn, mx)
            cn, cs = child.below(m, strict, n)
            return self._cn[j] + cn, self._cs[j] + cs
        return self._cn[-1], self._cs[-1]


def _leaf(index, chain, values):
    cell = _Cell(index, chain, None, None)
    cell.values = sorted(values)
    cell._vals = [x for x, _ in cell.values]
    cell._cn, cell._cs = [0], [0.0]
    for x, n in cell.values:
        cell._cn.append(cell._cn[-1] + n)
        cell._cs.append(cell._cs[-1] + x * n)
    return cell


def _fetch_around(self, j):
    """Detail of bucket j and its neighbours (not yet fetched, each small) in
    ONE job, as many as fit in ``local_rows`` values: later rounds whose
    midpoints move a little need no new job."""
    budget = self.index.local_rows
    lo_j = hi_j = j
    total = self.hist[j][1]
    while True:
        grew = False
        for nj in (lo_j - 1, hi_j + 1):
            if 0 <= nj < len(self.hist) and self.hist[nj][0] not in self.children \
                    and self.hist[nj][1] <= budget and total + self.hist[nj][1] <= budget:
                total += self.hist[nj][1]
                lo_j, hi_j = min(lo_j, nj), max(hi_j, nj)
                grew = True
        if not grew:
            break
    want = [self.hist[x][0] for x in range(lo_j, hi_j + 1) if self.hist[x][0] not in self.children]
    ix = self.index
    v = qcol(ix.column)
    b = _bucket(v, self.lo, self.w, ix.buckets)
    # a contiguous bucket range: one comparison pair, not a long IN list
    rows = (ix.df.where(self.cond(v) & b.between(self.hist[lo_j][0], self.hist[hi_j][0]))
            .groupBy(b.alias("b"), v.alias("v")).agg(F.count(F.lit(1)).alias("n")).collect())
    got = {}
    for r in rows:
        got.setdefault(r["b"], []).append((r["v"], r["n"]))
    for bb in want:
        self.children[bb] = _leaf(ix, self.chain + ((self.lo, self.w, ix.buckets, bb),), got.get(bb, []))


_Cell._fetch_around = _fetch_around


class PrefixIndex:
    def __init__(self, df: DataFrame, column: str, count: int, lo: float, hi: float,
                 buckets: int = 65_536, local_rows: int = 100_000):
        self.df = df.select(qcol(column).cast("double").alias(column))
        self.column, self.buckets, self.local_rows = column, buckets, local_rows
        self.count = count
        self.root = _Cell(self, (), lo, hi)

    def below(self, m: float, strict: bool = False):
        return self.root.below(m, strict, self.count)
