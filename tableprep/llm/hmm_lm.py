"""LM scoring by a hidden Markov language model (operator 2).

Words are counted over all training texts. The states emit word classes:
frequent words are classes of their own, the others fall into classes by their
last letters; within a class a word has its share of the class's counts (each
word's count plus one, and one for words never seen). Baum-Welch counts are
taken over all training texts, added up across partitions, round after round
until the likelihood hardly gains, and the scaled
forward recursion gives the exact likelihood of each text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_for, q, read, stored
from .compress_quality import held_out
from .hmm import expected_counts, first_guess, forward, groups, picked, reestimate
from .textblock import Words, byte_map, slices, trim

STATES = 8
#: Rounds go on until the log10 likelihood of the training texts gains less than this a token.
TOLERANCE = 0.001
#: The most frequent words (at most so many, of at most so many bytes) are sent to the tasks; the others are joined.
DICTIONARY, WORD_BYTES = 131_072, 64
OWN_CLASS = 16_384        # the most frequent of these are classes of their own
BUCKETS = 2_048           # classes of the other words, by their last SUFFIX bytes
SUFFIX = 3
SMOOTH = 100.0
GROUP = 400_000           # symbols packed at once in training
SEED = 2
RUN_BYTES = 1_000_000     # text worked on at once
_HELD = 200_000           # words (each once a run) a task gathers before it passes them on


def _table() -> np.ndarray:
    """Bytes of words: A-Z lower-cased, white space separates, NUL takes the place of the space."""
    out = byte_map(lower=True)
    out[0] = 0x20
    return out


_MAP = _table()


def _slices_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow binary array with the given pieces of ``data``."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], size)
    return offsets.astype(np.int64), data[at]


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """A binary array (of 32-bit offsets, as Spark takes them: a run of texts is far below 2 GB)."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                                                 pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def word_counts(texts: DataFrame) -> DataFrame:
    """``text`` binary -> ``(token, c)``; added up in the tasks by a 64-bit hash, then by token."""
    def run(batches):
        held, n = [], 0  # per run of texts: hashes, counts, words

        def out():
            h, c, place = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2))
            first, back = np.unique(h, return_index=True, return_inverse=True)[1:]
            total = np.bincount(back, weights=c).astype(np.int64)
            # the words themselves, from the run where each was first met
            offsets, data = [np.zeros(1, np.int64)], []
            which = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])[first]
            order = np.argsort(which, kind="stable")
            for r in np.unique(which).tolist():
                mine = place[first[order[which[order] == r]]]
                o, d = _slices_of(held[r][3], mine[:, 0], mine[:, 1])
                offsets.append(o[1:] + offsets[-1][-1])
                data.append(d)
            return pa.RecordBatch.from_arrays([_binary(np.concatenate(offsets), np.concatenate(data) if data else np.zeros(0, np.uint8)),
                                               pa.array(total[order])], ["token", "c"])
        for b in batches:
            for _, _, data, offsets in slices(b.column(0), RUN_BYTES):
                words = Words(data, offsets, _MAP)
                h, first, c = np.unique(words.hash, return_index=True, return_counts=True)
                o, d = _slices_of(words.bytes, words.start[first], words.end[first])
                held.append((h, c, np.stack([o[:-1], o[1:]], axis=1), d))
                n += len(h)
                if n > _HELD:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()
        trim()
    return texts.mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Classes and counts: 0 is the end, then words of their own, then the suffix buckets."""

    def __init__(self, words: list[bytes], counts: np.ndarray, mass: np.ndarray, n_end: int):
        own = min(OWN_CLASS, len(words))
        self.first_bucket = 1 + own
        self.n_classes = self.first_bucket + BUCKETS
        self.words, self.counts, self.n_end = words, counts, n_end
        self.classes = np.array([1 + i if i < own else self.first_bucket + bucket(w) for i, w in enumerate(words)], dtype=np.uint16)
        # mass of a bucket: its words' counts plus one each, and one for all unseen words
        self.mass = mass - np.bincount([bucket(w) for w in words[:own]], weights=counts[:own] + 1.0, minlength=BUCKETS) + 1.0
        total = np.concatenate([[n_end + 1.0], counts[:own] + 1.0, self.mass])
        self.prior = total / total.sum()

    def parts(self):
        """What encoding needs: hashes of the words in order, and by hash order their classes and log10(count + 1)."""
        offsets = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        spaced = np.frombuffer(b"".join(self.words) + bytes(8), dtype=np.uint8)
        h = Words.of_spans(spaced, offsets[:-1], offsets[1:])
        order = np.argsort(h, kind="stable")
        return h[order], self.classes[order], np.log10(self.counts + 1.0)[order], self.first_bucket, self.n_end


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % BUCKETS


def _crc_table() -> np.ndarray:
    """CRC-32 of single bytes, the step of the checksum that zlib and Spark share."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def buckets_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """:func:`bucket` of pieces of ``data``."""
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for k in range(SUFFIX, 0, -1):
        at = end - k
        there = at >= start
        new = _CRC[(crc ^ data[np.maximum(at, 0)]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        crc = np.where(there, new, crc)
    return ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(BUCKETS)).astype(np.int64)


def build_vocabulary(counts: DataFrame, n_docs: int) -> tuple[Vocabulary, int, int]:
    """(vocabulary, N, V) from the counts of all training words and the number of training texts."""
    # how many words are at least so frequent, in steps of a 64th of a doubling (some 3,000 rows at most)
    level = F.floor(F.log2("c") * 64).cast("int")
    hist = counts.groupBy(level.alias("lv")).agg(F.count("*").alias("words"), F.sum("c").alias("n"),
                                                 F.sum((F.octet_length("token") <= WORD_BYTES).cast("long")).alias("short")).collect()
    taken, least = 0, None
    for r in sorted(hist, key=lambda r: -r["lv"]):
        if taken + r["short"] > DICTIONARY:
            break
        taken, least = taken + r["short"], r["lv"]
    top = [] if least is None else counts.filter((level >= least) & (F.octet_length("token") <= WORD_BYTES)).collect()
    top = sorted(((r["c"], bytes(r["token"])) for r in top), key=lambda x: (-x[0], x[1]))
    of = F.pmod(F.crc32(F.substring("token", -SUFFIX, SUFFIX)), F.lit(BUCKETS))
    mass = np.zeros(BUCKETS)
    for r in counts.groupBy(of.alias("b")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r["b"]] = r["m"]
    vocab = Vocabulary([w for _, w in top], np.array([c for c, _ in top], dtype=np.int64), mass, n_docs)
    n = sum(r["n"] for r in hist) + n_docs
    return vocab, n, sum(r["words"] for r in hist) + (1 if n_docs else 0)


def encode(rows: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``rows`` (last column: binary text) with the text replaced by what scoring needs of it.

    ``classes``: 16-bit class of every word, and the end. ``known``, ``logs``: words of the
    dictionary and the sum of log10(count + 1) over them, the end included. ``spread``: that sum over words in buckets.
    ``rare``, ``rare_n``: the other words and how often each occurs.
    """
    shared, kept = rows.sparkSession.sparkContext.broadcast(vocab.parts()), rows.columns[:-1]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches):
        known, classes, logs, first_bucket, n_end = shared.value
        end_log = float(np.log10(n_end + 1.0))
        for b in batches:
            for row, n, data, offsets in slices(b.column(len(kept)), RUN_BYTES):
                w = Words(data, offsets, _MAP)
                doc = w.doc_of()
                at = np.minimum(np.searchsorted(known, w.hash), max(0, len(known) - 1))
                found = known[at] == w.hash if len(known) else np.zeros(len(w), bool)
                cls, val = np.zeros(len(w), dtype=np.int64), np.zeros(len(w))
                cls[found], val[found] = classes[at[found]], logs[at[found]]
                far = np.flatnonzero(~found)
                cls[far] = first_bucket + buckets_of(w.bytes, w.start[far], w.end[far])
                # each text's classes and, last, the end's
                size = np.diff(w.first) + 1
                symbols = np.zeros(len(w) + n, dtype=np.uint16)
                symbols[np.arange(len(w)) + doc] = cls
                # each text's other words, once, and how often they occur
                key = np.lexsort((w.hash[far], doc[far]))
                far = far[key]
                new = np.append(True, (doc[far][1:] != doc[far][:-1]) | (w.hash[far][1:] != w.hash[far][:-1]))[:len(far)]
                one = np.flatnonzero(new)
                times = np.diff(np.append(one, len(far)))
                lists = np.concatenate([[0], np.cumsum(np.bincount(doc[far[one]], minlength=n))]).astype(np.int32)
                each = lambda x: np.bincount(doc, weights=x, minlength=n).astype(np.float64)
                cols = [pa.array(size.astype(np.int64)), pa.array((each(found) + (1 if n_end else 0)).astype(np.int64)),
                        pa.array(each(val) + end_log), pa.array(each(np.where(cls >= first_bucket, val, 0.0))),
                        _binary(2 * np.concatenate([[0], np.cumsum(size)]), symbols),
                        pa.ListArray.from_arrays(lists, _binary(*_slices_of(w.bytes, w.start[far[one]], w.end[far[one]]))),
                        pa.ListArray.from_arrays(lists, pa.array(times.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(row, n) for i in range(len(kept))), *cols],
                                                 [*kept, "n_tokens", "known", "logs", "spread", "classes", "rare", "rare_n"])
        trim()
    return rows.mapInArrow(run, fields + ", n_tokens long, known long, logs double, spread double, classes binary, "
                                         "rare array<binary>, rare_n array<int>")


def _sequences(column) -> tuple[np.ndarray, np.ndarray]:
    """Class arrays of a binary Arrow column: all symbols, and offsets."""
    raw = [x.as_py() for x in column]
    offsets = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])]).astype(np.int64)
    return np.frombuffer(b"".join(raw), dtype=np.uint16), offsets


def baum_welch(encoded: DataFrame, params, prior: np.ndarray, smooth: float = SMOOTH):
    """One round over all rows of ``encoded``: tasks add up expected counts, Spark adds up the tasks."""
    return reestimate(*_counts(encoded, params, len(prior))[:3], prior, smooth)


def _counts(encoded: DataFrame, params, n_classes: int):
    """Expected starts, moves and emissions over all rows, and their log likelihood.

    The recursion runs in single precision (the likelihood moves in the ninth digit); counts add up as doubles, and
    scoring uses doubles throughout.
    """
    states = len(params[0])
    shared = encoded.sparkSession.sparkContext.broadcast(params)
    names = [f"e{i}" for i in range(states)]

    def run(batches):
        start, move, emit = shared.value
        starts, moves, emits, like = np.zeros(states), np.zeros((states, states)), np.zeros_like(emit), np.zeros(states)
        for b in batches:
            classes, offsets = _sequences(b.column(0))
            for p in groups(classes, offsets, GROUP):
                s, m, e, x = expected_counts(p, start, move, emit, np.float32)
                starts += s
                moves += m
                emits += e
                like[0] += x
        # one row per class seen; below zero the moves of each state, the starts and, last, the likelihood
        seen = np.flatnonzero(emits.any(axis=1))
        table = np.vstack([emits[seen], moves, starts[None], like[None]])
        keys = np.concatenate([seen, -1 - np.arange(states + 2)])
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), *(pa.array(table[:, i].copy()) for i in range(states))],
                                         ["k", *names])
        trim()
    rows = encoded.select("classes").mapInArrow(run, "k int, " + ", ".join(f"{n} double" for n in names))
    total = rows.groupBy("k").agg(*[F.sum(n).alias(n) for n in names]).toArrow()  # at most classes + states + 2 rows
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((n_classes, states))
    keys, like = total["k"].to_numpy(), 0.0
    table = np.stack([total[n].to_numpy() for n in names], axis=1) if len(keys) else np.zeros((0, states))
    emits[keys[keys >= 0]] = table[keys >= 0]
    for k, row in zip(keys[keys < 0].tolist(), table[keys < 0], strict=True):
        if k == -1 - states:
            starts = row
        elif k == -2 - states:
            like = float(row[0])
        else:
            moves[-1 - k] = row
    return starts, moves, emits, like


def train(encoded: DataFrame, vocab: Vocabulary, states: int = STATES, rounds: int | None = None):
    """Parameters: ``rounds`` of Baum-Welch over all rows from a random guess, by default until the gain is below TOLERANCE."""
    params = first_guess(vocab.prior, states, np.random.default_rng(SEED))
    tokens = max(1, encoded.agg(F.sum("n_tokens")).first()[0] or 0)
    last, done = -np.inf, 0
    while rounds is None or done < rounds:
        *counts, like = _counts(encoded, params, len(vocab.prior))
        params = reestimate(*counts, vocab.prior, SMOOTH)
        done += 1
        if rounds is None and like - last < TOLERANCE * np.log(10) * tokens:
            break
        last = like
    return params


def _forward_scores(encoded: DataFrame, params, vocab: Vocabulary, kept: list[str]) -> DataFrame:
    """``kept`` columns and ``path``: log10 likelihood of the classes less log10 of the masses of the buckets met."""
    log_mass = np.zeros(vocab.n_classes)
    log_mass[vocab.first_bucket:] = np.log10(vocab.mass)
    shared = encoded.sparkSession.sparkContext.broadcast((params, log_mass))

    def run(batches):
        (start, move, emit), mass = shared.value
        for b in batches:
            classes, offsets = _sequences(b.column(len(kept)))
            out = np.empty(len(offsets) - 1)
            for pick, p in picked(classes, offsets, GROUP):
                out[pick] = forward(p, start, move, emit) / np.log(10)
            spent = np.concatenate([[0.0], np.cumsum(mass[classes])])
            path = out - (spent[offsets[1:]] - spent[offsets[:-1]])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(path)], [*kept, "path"])
        trim()
    rows = encoded.select(*[q(c) for c in kept], "classes")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, fields + ", path double")


def score_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", held: Column | None = None,
                states: int = STATES, rounds: int | None = None) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per row of ``docs``.

    ``held``: condition for rows the model may not learn from (none by
    default). ``score`` is the log10 likelihood of the whole text, its end
    included; ``base_score`` that of the add-one unigram model.

    Defined results: a null text is empty: its end alone is scored; ids may be
    null or repeated; a text may hold one word of any length; with no training
    rows every word is unseen; an empty table gives an empty result; other columns are not read.
    """
    held = F.coalesce(held, F.lit(False)) if held is not None else F.lit(False)
    rows = docs.select(q(doc_id).alias("doc_id"), held.alias("held_out"),
                       F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    learn = rows.filter(~F.col("held_out"))
    n_docs = learn.count()
    counts = stored(word_counts(learn.select("text")), parts_for(n_docs))
    vocab, n, v = build_vocabulary(counts, n_docs)
    # the written row numbers name the rows from here on
    encoded = stored(encode(rows, vocab).withColumn("row", F.monotonically_increasing_id()), parts_for(docs.count()))
    params = train(encoded.filter(~F.col("held_out")), vocab, states, rounds)
    path = _forward_scores(encoded, params, vocab, ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "spread"])
    rare = encoded.filter(F.size("rare") > 0).select("row", F.inline(F.arrays_zip(F.col("rare").alias("token"), F.col("rare_n").alias("n"))))
    rare = rare.join(counts, "token").groupBy(F.col("row").alias("rare_row")).agg(
        F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_logs"))
    out = path.join(rare, F.col("row") == F.col("rare_row"), "left")
    more = F.coalesce("rare_logs", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
                      F.lit(n).cast("long").alias("train_tokens"),
                      (F.col("logs") + more - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"),
                      (F.col("path") + F.col("spread") + more).alias("score"))


def op2_hmm(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, held=held_out(F.col("doc_id"), 7, 2))
