"""SimHash near-duplicates by Golay-code fuzzy hashing (operator 3).

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two
fingerprints at most two bits apart agree in one segment (three segments, two
errors) and differ by at most two bits in the next, so they share a
codeword index among the indices within one bit of it. A key is the exact segment and one index of the
next; keys with several fingerprints are joined and the distance verified.
Keys held by very many fingerprints (a large group of near copies) are not
joined pairwise: their fingerprints are grouped by the words within one bit,
where two share one exactly if they are at most two bits apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, parts_for, q, read, stored
from .components import components
from .golay import ball_indices
from .textblock import trim

SHINGLE, MAX_BITS = 3, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
#: Keys with more fingerprints than this are grouped by neighbouring words.
JOIN_MOST = 32
NODES_PER_FILE = 25_000
_CHUNK = 200_000  # shingles whose bits are added up at once


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text: the majority bits of its shingles' hashes, repeats included."""
    words = text.lower().split()  # bytes: exactly ASCII letters and ASCII white space
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(line[s:e], 42) for s, e in zip(starts[at:at + _CHUNK], ends[at:at + _CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, *, text: str = "text", keep: list[Column], names: list[str], shingle: int = SHINGLE) -> DataFrame:
    """``keep`` columns under ``names`` with ``fp`` (the 64 bits as a signed long), one row per row of ``docs``."""
    rows = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)],
                       F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("fp_text"))
    kept = rows.drop("fp_text").schema

    def run(batches):
        for b in batches:
            fps = _signed(np.array([fingerprint(t, shingle) for t in b.column(len(names)).to_pylist()], dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(fps)], [*names, "fp"])
        trim()
    return rows.mapInArrow(run, kept.add("fp", "long"))


def fuzzy_keys(fps: DataFrame) -> DataFrame:
    """``fp`` -> one row ``(key, fp)`` per segment and codeword index (about 16 each).

    Key: segment number, the exact bits of that segment, an index of the next.
    """
    def run(batches):
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint64)
            for s, (first, bits) in enumerate(SEGMENTS):
                nxt, nbits = SEGMENTS[(s + 1) % len(SEGMENTS)]
                seg = (v >> np.uint64(first)) & np.uint64((1 << bits) - 1)
                idx = np.sort(ball_indices((v >> np.uint64(nxt)) & np.uint64((1 << nbits) - 1), nbits), axis=1)
                new = np.ones(idx.shape, dtype=bool)
                new[:, 1:] = idx[:, 1:] != idx[:, :-1]
                row, col = np.nonzero(new)
                key = (np.uint64(s) << np.uint64(34)) | (seg[row] << np.uint64(12)) | idx[row, col].astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(v[row].view(np.int64))], ["key", "fp"])
        trim()
    return fps.mapInArrow(run, "key long, fp long")


def near_pairs(fps: DataFrame, max_bits: int = MAX_BITS, join_most: int = JOIN_MOST) -> DataFrame:
    """Links ``(a, b)`` among distinct fingerprints ``fp`` that connect all pairs at most ``max_bits`` apart.

    Every link is a true pair (distance at most ``max_bits``), and any two
    fingerprints that close are joined by a link or by a path of links.
    """
    if max_bits != 2:
        raise ValueError("the keys guarantee exactly distances of two bits or less")
    parts = parts_for(fps.count(), NODES_PER_FILE)
    keys = stored(fuzzy_keys(fps), parts)
    held = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(keys.join(held, "key"), parts)  # most keys belong to one fingerprint and end here
    # keys of a few fingerprints: all pairs of a bounded list, verified
    few = shared.filter(F.col("n") <= join_most).groupBy("key").agg(F.collect_list("fp").alias("all_"))
    few = few.select(F.explode("all_").alias("a"), "all_").select("a", F.explode(F.filter(
        "all_", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= max_bits))).alias("b"))
    # keys of many: words within one bit; a word is met by 65 fingerprints at most, all at most two bits apart
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x - (1 << 64) if x >> 63 else x) for x in (1 << i for i in range(64))])
    many = shared.filter(F.col("n") > join_most).select("fp").distinct()
    words = many.select("fp", F.explode(F.transform(flips, lambda f: f.bitwiseXOR(F.col("fp")))).alias("word"))
    stars = words.groupBy("word").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all_")).filter(F.size("all_") > 1)
    stars = stars.select("a", F.explode("all_").alias("b")).filter("a <> b")
    return few.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links, its own included.

    Defined results: null and wordless texts have fingerprint 0, linked like
    any other; rows of equal id or text simply share a fingerprint; rows with a null id
    take part and get the smallest id of their component (null if it has
    none); an empty table gives an empty result; other columns are not read.
    Documents of one fingerprint are one node of the graph, so a group of
    copies of any size costs one node.
    """
    marked = stored(fingerprints(docs, text=text, keep=[q(doc_id)], names=["doc_id"], shingle=shingle), parts_for(docs.count()))
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), parts_for(marked.count(), NODES_PER_FILE))
    comp = components(near_pairs(nodes.select("fp"), max_bits), parts_for(nodes.count(), NODES_PER_FILE))
    roots = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    of = roots.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return marked.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows that tie on that id (repeated rows) stay once. A group whose ids are
    all null keeps one row.
    """
    node, key, keep = fresh(docs, "dedup_node", "dedup_key", "dedup_keep")
    plain = [q(c.name) for c in docs.schema if not isinstance(c.dataType, T.MapType)]
    # rows of one id are told apart by their content; ids that are null come last
    ident = F.xxhash64(*plain)
    marked = near_duplicates(docs.withColumn(node, F.struct(q(doc_id).isNull().alias("none"), q(doc_id).alias("id"), ident.alias("h"))),
                             doc_id=node, text=text, **options)
    as_key = lambda i, h: F.concat_ws(":", i.cast("string"), h.cast("string"))
    best = (marked.filter(F.col("doc_id") == F.col("component_id"))
            .select(as_key(F.col("doc_id.id"), F.col("doc_id.h")).alias(keep)).distinct())
    kept = docs.withColumn(key, as_key(q(doc_id), ident))
    kept = kept.join(best, kept[key] == best[keep], "left_semi")
    return kept.dropDuplicates([key]).select(*[q(c) for c in docs.columns])


def op3_simhash(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
