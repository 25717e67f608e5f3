"""Ranked lexical search by norm buckets (operator 11).

Documents and items are sparse vectors over the items' terms: a document has
the impact of each term in it, an item each term's weight times its repeats;
the score is their product. Documents are ordered by the length of their
vectors and searched in buckets from the longest down. With the score an item
must at least reach, a bucket falls out if the product of the lengths cannot
reach it (Cauchy-Schwarz); inside a bucket the greatest impact of each
coordinate and the length left over bound what a document can still get; the
documents that survive are scored exactly in integers.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts_for, q, read, stored
from .textblock import Words, slices, trim

TOP = 20
#: A term: a run of letters and digits; all of ASCII but these separates, other characters are letters.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Documents of a bucket; those of the first bucket, searched beforehand for the items' first thresholds.
BUCKET, FIRST = 2_000, 2_000
#: Items a task holds at once; more are searched block by block, each a pass over all documents.
BLOCK_BYTES = 8_000_000
_EPS = 1e-9  # bounds are rounded; they prune only by more than that


def _term_map() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    out[[c for c in range(128) if not chr(c).isalnum()]] = 0
    return out


_MAP = _term_map()


class Block:
    """Items as vectors: ``terms`` and ``times`` of item i at ``start[i]:start[i + 1]``, places in ``vocabulary``."""

    def __init__(self, rows: list[tuple[object, bytes]]):
        self.ids = [i for i, _ in rows]
        bags = []
        for _, text in rows:
            words = Words(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]), _MAP)
            bags.append(np.unique(words.hash, return_counts=True))
        every = [h for h, _ in bags]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *every]))
        self.start = np.cumsum([0, *(len(h) for h in every)])
        self.terms = np.searchsorted(self.vocabulary, np.concatenate([np.zeros(0, np.uint64), *every]))
        self.times = np.concatenate([np.zeros(0, np.int64), *(n for _, n in bags)]).astype(np.int64)

    def find(self, h: np.ndarray, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are terms of an item, and their places in the vocabulary."""
        at = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, h[at])
        place[place == len(self.vocabulary)] = 0
        good = self.vocabulary[place] == h[at] if len(self.vocabulary) else np.zeros(len(at), bool)
        return at[good], place[good]

    def maybe(self) -> np.ndarray:
        out = np.zeros(1 << 16, dtype=bool)
        out[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        return out


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L, in 64-bit integers."""
    if 25 * int(n.max(initial=0)) * n_docs >= 1 << 63:
        raise OverflowError("25 * n * N leaves 64 bits")
    m = 75 + 25 * n * n_docs // n_terms
    return 10**9 * tf // (1000 * tf + 12 * m)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def vectors(docs: DataFrame, doc_id: str, text: str, block: Block, n_docs: int, n_terms: int) -> DataFrame:
    """``(doc_id, length, terms, impacts)`` of the documents that hold a term of the block's items."""
    shared = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("length", T.DoubleType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("impacts", T.ArrayType(T.IntegerType()))])

    def run(batches):
        block = shared.value
        maybe, size = block.maybe(), max(1, len(block.vocabulary))
        for b in batches:
            for row, n_rows, data, offsets in slices(b.column(1)):
                words = Words(data, offsets, _MAP)
                at, place = block.find(words.hash, maybe)
                doc = np.searchsorted(words.first, at, "right") - 1
                key, tf = np.unique(doc * size + place, return_counts=True)
                doc, place = key // size, key % size
                if not len(doc):
                    continue
                v = impacts(tf.astype(np.int64), np.diff(words.first)[doc], n_docs, n_terms)
                some, first = np.unique(doc, return_index=True)
                length = np.sqrt(np.add.reduceat(v.astype(np.float64) ** 2, first))
                ends = pa.array(np.append(first, len(doc)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row + some)), pa.array(length), pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
                     pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32)))], schema.names)
        trim()
    return docs.select(q(doc_id).alias("doc_id"), F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("t")).mapInArrow(run, schema)


class Best:
    """The best documents of one item so far: highest score, then null id, then smallest id."""

    def __init__(self, top: int, least: int):
        self.top, self.least = top, least  # documents below ``least`` are known not to be among the best
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.known = np.zeros(0, bool)

    def add(self, score, ids, known):
        score, ids, known = (np.concatenate(p) for p in ((self.score, score), (self.id, ids), (self.known, known)))
        keep = np.lexsort((ids, known, -score))[:self.top]
        self.score, self.id, self.known = score[keep], ids[keep], known[keep]
        if len(self.score) == self.top:
            self.least = max(self.least, int(self.score[-1]))


class Bucket:
    """Documents of similar length: postings by term for the bounds, coordinates by document for exact scores."""

    def __init__(self, length: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int):
        self.n, self.length, self.size = len(length), length, size
        doc = np.repeat(np.arange(self.n), np.diff(ends))
        self.cell, self.value = doc * size + terms, values  # sorted: documents in order, terms rising in each
        order = np.argsort(terms, kind="stable")
        self.term, self.doc, self.impact = terms[order], doc[order], values[order]
        self.longest = float(length.max(initial=0))

    def lists(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each term: where its postings begin and end, and their greatest impact."""
        lo, hi = np.searchsorted(self.term, terms, "left"), np.searchsorted(self.term, terms, "right")
        most = np.zeros(len(terms), np.int64)
        some = np.flatnonzero(hi > lo)
        if len(some):
            begins = np.flatnonzero(np.append(True, self.term[1:] != self.term[:-1]))
            most[some] = np.maximum.reduceat(self.impact, begins)[np.searchsorted(begins, lo[some])]
        return lo, hi, most

    def exact(self, docs: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Integer products of documents with an item's coordinates."""
        out = np.zeros(len(docs), np.int64)
        step = max(1, 2_000_000 // max(1, len(terms)))
        for i in range(0, len(docs), step):
            cells = docs[i:i + step, None] * self.size + terms[None]
            at = np.minimum(np.searchsorted(self.cell, cells), len(self.cell) - 1)
            out[i:i + step] = (np.where(self.cell[at] == cells, self.value[at], 0) * weights[None]).sum(axis=1)
        return out

    def search(self, terms, weights, norm, lo, hi, most, best: Best) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the item's best, and their exact scores."""
        none = np.zeros(0, np.int64)
        there = np.flatnonzero((hi > lo) & (weights > 0))
        gain = weights[there] * most[there]  # the most that a coordinate can add
        least = best.least * (1 - _EPS)
        if norm * self.longest < least or gain.sum() < best.least or not len(there):
            return none, none
        there = there[np.argsort(-gain, kind="stable")]
        # a document that holds none of the first coordinates gets less than it needs from the others
        rest = np.append(np.cumsum((weights[there] * most[there])[::-1])[::-1][1:], 0)
        n_first = int(np.argmax(rest < max(best.least, 1))) + 1
        first, other = there[:n_first], there[n_first:]
        counts = hi[first] - lo[first]
        at = np.repeat(lo[first] - np.append(0, np.cumsum(counts)[:-1]), counts) + np.arange(counts.sum())
        doc, v = self.doc[at], self.impact[at]
        got = np.bincount(doc, weights=v * np.repeat(weights[first], counts).astype(np.float64), minlength=self.n)
        squares = np.bincount(doc, weights=v.astype(np.float64) ** 2, minlength=self.n)
        left = np.sqrt(float((weights[other].astype(np.float64) ** 2).sum()) * np.maximum(self.length ** 2 * (1 + _EPS) - squares, 0))
        docs = np.flatnonzero((got > 0) & (got + np.minimum(left, float(rest[n_first - 1])) >= least))
        if not len(docs):
            return none, none
        score = self.exact(docs, terms[there], weights[there])
        keep = (score > 0) & (score >= best.least)
        return docs[keep], score[keep]


def _found(rows: DataFrame, block: Block, weights: np.ndarray, least: np.ndarray, top: int, id_type: T.DataType) -> DataFrame:
    """``(k, item_id, doc_id, score)``: of each task the best documents of each item (number k of the block)."""
    shared = rows.sparkSession.sparkContext.broadcast((block, weights, least))
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("item_id", id_type),
                           T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        block, weights, least = shared.value
        size, items = max(1, len(block.vocabulary)), range(len(block.ids))
        best = [Best(top, int(x)) for x in least]
        spans = [slice(block.start[k], block.start[k + 1]) for k in items]
        norms = [float(np.sqrt((weights[s].astype(np.float64) ** 2).sum())) for s in spans]
        for b in batches:
            for i in range(0, b.num_rows, BUCKET):
                part = b.slice(i, BUCKET)
                terms, values = part.column(2), part.column(3)
                ends = np.append(0, np.cumsum(terms.value_lengths().to_numpy(zero_copy_only=False)))
                bucket = Bucket(part.column(1).to_numpy(), ends, terms.flatten().to_numpy().astype(np.int64),
                                values.flatten().to_numpy().astype(np.int64), size)
                known = part.column(0).is_valid().to_numpy(zero_copy_only=False)
                ids = part.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                lo, hi, most = bucket.lists(block.terms)
                for k, s in enumerate(spans):
                    docs, score = bucket.search(block.terms[s], weights[s], norms[k], lo[s], hi[s], most[s], best[k])
                    if len(docs):
                        best[k].add(score, ids[docs], known[docs])
        for k in items:
            x = best[k]
            if len(x.score):
                cols = [pa.array([k] * len(x.score), arrow.field(0).type), pa.array([block.ids[k]] * len(x.score), arrow.field(1).type),
                        pa.array(x.id, mask=~x.known), pa.array(x.score)]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        trim()
    return rows.mapInArrow(run, schema)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("k").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    """The items in blocks of about ``block_bytes`` of text, by a range of their hash."""
    rows = items.select(q(item_id).alias("i"), F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        yield Block([(r["i"], bytes(r["t"])) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()])


def search(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
           item_text: str = "text", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` documents of highest score above 0 for each item.

    Terms are runs of ASCII letters and digits and of all other characters beyond ASCII, A-Z lower-cased; equal scores
    go by ascending id, which must be an integer. A block of items (of at most ``block_bytes`` of text) goes to every
    task; the corpus statistics and the documents' vectors cover all documents. Vectors are stored once per block;
    each task sends at most ``top`` rows an item, and only such as beat the thresholds of the first bucket.

    Defined results: null, empty and term-less documents are never found and null or term-less items find nothing;
    a null id sorts first; repeated documents rank one after the other; repeated items each get their ranks; empty
    tables give an empty result; other columns are not read. A table so large that 25 * n * N, or an item so long that
    its greatest score, leaves 64 bits is an error.
    """
    id_type = items.schema[item_id].dataType
    body = F.regexp_count(F.coalesce(q(text).cast("string"), F.lit("")), F.lit(TERM)).cast("long")
    n_docs, n_terms, n_rows = docs.select(body.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n"), F.count("*")).first()
    out = None
    for block in _blocks(items, item_id, item_text, block_bytes):
        part = _search_block(docs, doc_id, text, block, n_docs, n_terms or 1, n_rows, top, id_type)
        out = part if out is None else out.unionByName(part)
    return out


def _search_block(docs, doc_id, text, block, n_docs, n_terms, n_rows, top, id_type) -> DataFrame:
    rows = vectors(docs.withColumn(doc_id, q(doc_id).cast("long")), doc_id, text, block, n_docs, n_terms)
    rows = stored(rows, parts_for(n_rows))
    df = np.zeros(max(1, len(block.vocabulary)), np.int64)
    for t, n in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row for each term of the block
        df[t] = n
    weights = np.array([weight(n_docs, int(df[t])) * int(k) for t, k in zip(block.terms, block.times, strict=True)], np.int64)
    for k in range(len(block.ids)):
        if sum(map(int, weights[block.start[k]:block.start[k + 1]])) * 10**6 >= 1 << 63:
            raise OverflowError("an item's greatest score leaves 64 bits")
    # the first bucket: the longest vectors; what an item gets there it must reach elsewhere
    least = np.zeros(len(block.ids), np.int64)
    share = max(0.0, 1 - FIRST / max(1, n_rows))
    edge = rows.agg(F.percentile_approx("length", share, 10_000)).first()[0]
    if edge is not None:
        for r in _ranked(_found(rows.filter(F.col("length") >= edge), block, weights, least, top, id_type), top).filter(F.col("rank") == top).collect():
            least[r["k"]] = r["score"]
    ordered = rows.repartitionByRange(F.desc("length"), F.xxhash64("doc_id", "length")).sortWithinPartitions(F.desc("length"))
    found = _ranked(_found(ordered, block, weights, least, top, id_type), top)
    return found.select("item_id", "rank", "doc_id", "score")


def op11_lemp(spark, sf_dir):
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The scores of all documents that share a term with an item, without buckets or bounds.
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{TERM}') AS terms FROM documents),
w AS (SELECT r, unnest(terms) AS term FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM w GROUP BY r, term),
n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM n),
b AS (SELECT row_number() OVER () AS k, item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{TERM}') AS terms FROM benchmark),
bt AS (SELECT k, term, count(*) AS times FROM (SELECT k, unnest(terms) AS term FROM b) GROUP BY k, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM df, s),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * nd) // l) AS m FROM n, s),
score AS (SELECT bt.k, m.r, any_value(m.doc_id) AS doc_id, CAST(sum(bt.times * wt.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * m.m))) AS BIGINT) AS score
          FROM bt JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY bt.k, m.r),
top AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM score WHERE score > 0)
SELECT b.item_id, CAST(top.rank AS INTEGER) AS rank, top.doc_id, top.score FROM top JOIN b USING (k) WHERE top.rank <= {TOP}"""
