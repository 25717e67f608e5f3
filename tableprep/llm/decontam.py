"""Benchmark decontamination by SimHash windows (operator 4).

A window of a document, as many words long as an item, gets a SimHash of its
word shingles; it is compared with the items of that length whose SimHash
lies within a Hamming radius, found by multi-index blocks (the 64 bits are cut
into blocks so that any two fingerprints within the radius differ by at most
one bit in some block), and a candidate counts if the exact weighted-shingle
similarity reaches the threshold. Only windows that share a shingle with some
item are fingerprinted: without one the similarity is zero.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, parts_for, q, read, small, stored
from .textblock import Words, byte_map, slices, trim

SHINGLE, THRESHOLD = 5, 0.8
RADIUS, BLOCKS = 21, 11      # 21 < 2 * 11: some block differs by one bit at most
#: Items a task holds at once; a larger benchmark is searched part by part.
PART_BYTES = 8_000_000
_MAP = byte_map(lower=True, punctuation=True)


def _block_bounds(blocks: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _simhash(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Majority bits: ``counts`` (windows, 64) of ``n`` shingles each."""
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _shingles(words: Words, lo: int, hi: int, k: int) -> np.ndarray:
    """Shingle hashes of words lo..hi of one text (fewer than k words: the whole sequence)."""
    n = hi - lo
    k = min(k, n)
    out = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    h = words.hash
    for j in range(k):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + h[lo + j:lo + j + len(out)]
    return out ^ (out >> np.uint64(31))


class Items:
    """A part of the benchmark, indexed: shingles -> items, (length, fingerprint block) -> items."""

    def __init__(self, items: list[tuple[int, bytes]], shingle: int, radius: int, blocks: int):
        self.shingle, self.radius = shingle, radius
        self.bounds = _block_bounds(blocks)
        if radius >= 2 * blocks:
            raise ValueError("radius must be below twice the number of blocks")
        self.ids, self.length, self.bags, self.fp = [], [], [], []
        by_shingle = defaultdict(set)
        for item, text in items:
            w = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), _MAP)
            if not len(w):
                continue  # an item without words matches nothing
            h = _shingles(w, 0, len(w), shingle)
            me = len(self.ids)
            self.ids.append(item)
            self.length.append(len(w))
            self.bags.append(Counter(h.tolist()))
            self.fp.append(int(_simhash(_bits(h).sum(axis=0, dtype=np.int64)[None], np.array([len(h)]))[0]))
            for x in self.bags[-1]:
                by_shingle[x].add(me)
        self.by_shingle = dict(by_shingle)
        self.known = np.array(sorted(by_shingle), dtype=np.uint64)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True
        self.block = [defaultdict(list) for _ in self.bounds]
        for me, fp in enumerate(self.fp):
            for index, (first, bits) in zip(self.block, self.bounds, strict=True):
                v = fp >> first & (1 << bits) - 1
                for value in (v, *(v ^ 1 << b for b in range(bits))):
                    index[self.length[me], value].append(me)

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        return at[np.isin(h[at], self.known)]

    def near(self, fp: int, length: int) -> list[int]:
        """Items of the given length within the radius of a fingerprint."""
        found = {me for index, (first, bits) in zip(self.block, self.bounds, strict=True)
                 for me in index.get((length, fp >> first & (1 << bits) - 1), ())}
        return [me for me in found if (self.fp[me] ^ fp).bit_count() <= self.radius]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags of shingles (each weighs as often as it occurs)."""
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def search_text(words: Words, lo: int, hi: int, hit: np.ndarray, items: Items, threshold: float) -> list[tuple[int, float, int, int]]:
    """Matches in the words lo..hi of one text: (item, similarity, first word, words), the best window of each item.

    ``hit``: indices (from lo) of shingles of the text that some item has.
    """
    k, n = items.shingle, hi - lo
    h = _shingles(words, lo, hi, k)
    spans = defaultdict(list)  # window length -> ranges of window starts
    for p in hit.tolist():
        for length in {items.length[me] for me in items.by_shingle[int(h[p])]}:
            room = max(0, n - length)
            spans[length].append((min(max(0, p - max(0, length - k)), room), min(p, room)))
    best = {}
    for length, ranges in spans.items():
        starts = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in ranges]))
        m = max(1, min(length, n) - k + 1)  # shingles of a window
        for at in np.array_split(starts, -(-len(starts) // 2000)):
            first, last = int(at[0]), int(at[-1]) + m
            sums = np.zeros((last - first + 1, 64), dtype=np.int32)
            np.cumsum(_bits(h[first:last]), axis=0, out=sums[1:])
            fps = _simhash(sums[at - first + m] - sums[at - first], np.full(len(at), m))
            for start, fp in zip(at.tolist(), fps.tolist(), strict=True):
                near = items.near(fp, length)
                if near:
                    bag = Counter(h[start:start + m].tolist())
                    for me in near:
                        s = similarity(bag, items.bags[me])
                        if s >= threshold and (me not in best or s > best[me][0]):
                            best[me] = (s, start, min(length, n))
    return [(items.ids[me], *x) for me, x in sorted(best.items())]


def _parts(benchmark: DataFrame, item_id: str, text: str, part_bytes: int):
    """The benchmark in parts of about ``part_bytes`` of text, by a range of the id's hash."""
    rows = benchmark.select(q(item_id).alias("i"), F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // part_bytes))
    for k in range(n):
        yield [(r["i"], bytes(r["t"])) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, radius: int = RADIUS,
               blocks: int = BLOCKS, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document row and item it holds: ``(doc_id, item_id, similarity, first_word, n_words)``.

    Words are runs of letters and digits (ASCII punctuation and white space
    separate, A-Z are lower-cased). The best window of each item is given.

    Defined results: null, empty and wordless texts or items match nothing;
    texts shorter than an item are one window; items shorter than a shingle
    are compared as one whole sequence; repeated rows are searched alike and
    repeated items give a row each; empty tables give an empty result; other columns are not read.
    The tasks hold one part of the benchmark at a time, bounded by ``part_bytes``
    (each part is one pass over the documents).
    """
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", benchmark.schema[item_id].dataType),
                           T.StructField("similarity", T.DoubleType()), T.StructField("first_word", T.LongType()),
                           T.StructField("n_words", T.LongType())])
    rows = docs.select(q(doc_id).alias("doc_id"), F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    out = None
    for part in _parts(benchmark, item_id, item_text, part_bytes):
        shared = spark.sparkContext.broadcast(part)
        found = rows.mapInArrow(_searcher(shared, shingle, threshold, radius, blocks, schema), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared, shingle, threshold, radius, blocks, schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        # a worker keeps a broadcast from task to task, and with it the index of its items
        items = getattr(shared, "indexed", None)
        if items is None:
            items = shared.indexed = Items(shared.value, shingle, radius, blocks)
        short = sorted({n for n in items.length if n < shingle})
        for b in batches:
            ids, found = b.column(0), []
            for row, n, data, offsets in slices(b.column(1)):
                words = Words(data, offsets, _MAP)
                h, at = _run_windows(words, shingle)
                hit = at[items.hits(h)]
                where = np.searchsorted(words.first, hit, "right") - 1
                for d in np.unique(where).tolist():
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    for m in search_text(words, lo, hi, hit[where == d] - lo, items, threshold):
                        found.append((row + d, *m))
                found += [(row + d, *m) for length in short for d, m in _short_matches(words, length, items)]
            if found:
                take = ids.take(pa.array([f[0] for f in found], pa.int64()))
                cols = [take, *(pa.array([f[i] for f in found], arrow.field(i).type) for i in range(1, 5))]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        trim()
    return run


def _run_windows(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes (as ``_shingles`` gives them) of all texts of a run, and their first words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = _shingles(words, 0, len(words), k)
    doc = words.doc_of()
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return h[at], at


def _short_matches(words: Words, length: int, items: Items):
    """Items of fewer words than a shingle: one sequence, found or not (its first place in each text)."""
    h, at = _run_windows(words, length)
    best = {}
    for p in items.hits(h).tolist():
        d = int(np.searchsorted(words.first, at[p], "right")) - 1
        for me in items.by_shingle[int(h[p])]:
            if items.length[me] == length:
                best.setdefault((d, me), (items.ids[me], 1.0, int(at[p] - words.first[d]), length))
    return [(d, m) for (d, _), m in best.items()]


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage (same columns).

    Rows are told apart by id and text, so a null or repeated id is no matter.
    """
    (mark,) = fresh(docs, "leak_row")
    marked = docs.withColumn(mark, F.concat_ws(":", q(doc_id).cast("string"), F.xxhash64(q(text)).cast("string")))
    bad = stored(find_leaks(marked, benchmark, doc_id=mark, text=text, **options).select(F.col("doc_id").alias("leak_of")).distinct(),
                 parts_for(docs.count(), 5_000_000))
    return marked.join(small(bad, bad.count()), marked[mark] == bad["leak_of"], "left_anti").select(*[q(c) for c in docs.columns])


def op4_decontam(spark, sf_dir):
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
