"""Compression classifier for quality (operator 8).

Two zstandard dictionaries, one from good and one from bad labelled text: a
text that compresses better with the good one is likelier good. The
difference of the two compressed sizes over the root of the text's size (its
spread grows like that) is turned into a probability by a logistic curve fitted on labelled texts that neither
dictionary saw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, q, read
from .labelled import clear_labels, logistic, sample_ids
from .textblock import trim

#: Bounds of the labelled sample: texts of each label for the dictionaries, and as many for the curve;
#: of the dictionary texts at most this many pieces of PIECE bytes, by hash.
SAMPLE_DOCS, PIECE, SAMPLE_PIECES = 2_000, 4_096, 2_500
DICT_BYTES, LEVEL = 112_640, 3
THRESHOLD = 0.3
SEED = 8


def make_dictionary(pieces: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A trained dictionary; too few pieces to train on serve as they are."""
    try:
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def _compressor(raw: bytes, level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)


def _differences(rows: DataFrame, good: bytes, bad: bytes, level: int, out: str) -> DataFrame:
    """``rows``, whose last column is binary text, with that column replaced by the size difference ``out``."""
    kept = rows.columns[:-1]

    def run(batches):
        a, b = _compressor(good, level), _compressor(bad, level)
        for batch in batches:
            texts = batch.column(len(kept))
            diff = np.fromiter(((len(b.compress(t)) - len(a.compress(t))) / np.sqrt(len(t) + 1) for t in (x.as_py() for x in texts)),
                               np.float64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(diff)], [*kept, out])
        trim()
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.DoubleType())]))


class QualityModel:
    """Two dictionaries and the curve ``slope * difference + shift``."""

    def __init__(self, good: bytes, bad: bytes, slope: float, shift: float, level: int = LEVEL):
        self.good, self.bad, self.slope, self.shift, self.level = good, bad, slope, shift, level

    def score(self, docs: DataFrame, *, text: str = "text", name: str = "score") -> tuple[DataFrame, str]:
        """Rows of ``docs`` with the probability of good; returns the frame and the added column."""
        raw, out = fresh(docs, "quality_text", name)
        rows = docs.withColumn(raw, F.coalesce(q(text).cast("string"), F.lit("")).cast("binary"))
        diff = _differences(rows, self.good, self.bad, self.level, out)
        z = F.lit(self.slope) * q(out) + F.lit(self.shift)
        return diff.withColumn(out, 1 / (1 + F.exp(-z))), out


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          learn: Column | None = None, sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """The model from labelled documents for which ``learn`` (a condition on ``label_id``) holds.

    Half of the labelled ids, by hash, feed the dictionaries and the other half the
    curve. Without both labels there is nothing to learn and every score is 0.5.
    """
    known = clear_labels(labels, doc_id, good=q(label))
    if learn is not None:
        known = known.filter(learn)
    half = F.pmod(F.xxhash64(F.lit(SEED), "label_id"), F.lit(2))
    texts = docs.select(q(doc_id).alias("label_id"), F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("raw"))

    ids = [sample_ids(known.filter(half == k), ["good"], sample_docs, SEED + 1) for k in (0, 1)]
    picked = [texts.join(F.broadcast(few), "label_id") for few, _ in ids]  # at most sample_docs ids of each label
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.octet_length("raw") - 1, F.lit(0)).cast("int"), F.lit(PIECE)))
    pieces = picked[0].select("good", "label_id", "raw", at.alias("at"))
    pieces = pieces.select("good", "label_id", "at", F.expr(f"substring(raw, at + 1, {PIECE})").alias("piece"))
    pieces = pieces.filter(F.octet_length("piece") >= 8)
    dicts = []
    for k in (1, 0):
        rows = pieces.filter(F.col("good") == k).orderBy(F.xxhash64("label_id", "at"), "label_id", "at").limit(SAMPLE_PIECES)
        dicts.append(make_dictionary([bytes(r["piece"]) for r in rows.select("piece").collect()]))
    seen = _differences(picked[1].select("good", "raw"), *dicts, LEVEL, "d").collect()
    y = np.array([r["good"] for r in seen], dtype=float)
    d = np.array([r["d"] for r in seen], dtype=float)
    if not all(dicts) or len(set(y)) < 2:
        return QualityModel(*dicts, 0.0, 0.0)
    # the sample may hold the labels in other shares than the labelled rows do
    sizes = ids[1][1]
    weight = np.where(y == 1, sizes[(1,)] / (y == 1).sum(), sizes[(0,)] / (y == 0).sum())
    scale = d.std() or 1.0
    w, shift = logistic((d / scale)[:, None], y, weight / weight.mean())
    return QualityModel(*dicts, float(w / scale), float(shift))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, text: str = "text", **options) -> tuple[DataFrame, str, str]:
    """Rows of ``docs`` with ``score`` and ``predicted``; returns the frame and the two names.

    Defined results: null and empty texts have the score of a zero difference;
    whole texts are compressed, however long; repeated rows get equal scores;
    an empty table gives an empty result; labels that are null, contradict
    each other or lack a document are not learned from; added columns are renamed if ``docs`` has them.
    """
    rows, score = train(docs, labels, text=text, **options).score(docs, text=text)
    (predicted,) = fresh(rows, "predicted")
    return rows.withColumn(predicted, (q(score) >= threshold).cast("int")), score, predicted


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest`` modulo ``mod`` (null id: as an empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(mod)) == rest


def op8_quality(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, score, predicted = classify(docs, read(spark, sf_dir, "labels"), learn=~held_out(F.col("label_id"), 5, 0))
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), q(score).alias("score"),
                      q(predicted).alias("predicted"))
