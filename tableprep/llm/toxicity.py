"""Toxicity by a classifier chain (operator 5).

The categories are predicted one after another, each by a linear model over
word features whose inputs also hold the logits of the earlier categories.
In training those earlier inputs are out-of-fold predictions, so that a later model sees
them as uncertain as they are on new texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, q, read
from .labelled import clear_labels, logistic, sample_ids, sigmoid
from .textblock import Words, byte_map, slices, trim

#: Bounds of the labelled sample: documents of each combination of labels, features of each category.
SAMPLE_DOCS, FEATURES = 3_000, 400
PREFIXES = tuple(range(4, 11))   # bytes of a longer word's beginning that are features as well: stems
MIN_DOCS = 5
FOLDS = 5
CLIP = 8.0   # bound of a logit that feeds a later model
RIDGE = 10.0
THRESHOLD = 0.3
SEED = 5
_MAP = byte_map(lower=True, punctuation=True)


def _word_features(w: Words, which: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index into ``which``, feature hash): each word itself and its beginnings."""
    start, end = w.start[which], w.end[which]
    yield np.arange(len(which)), w.hash[which]
    for k in PREFIXES:
        longer = np.flatnonzero(end - start > k)
        yield longer, w.hash_spans(start[longer], start[longer] + k) ^ np.uint64(k)


def _feature_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text of the run, feature hash), each feature once per text."""
    doc = w.doc_of()
    pairs = list(_word_features(w, np.arange(len(w))))
    docs = np.concatenate([doc[i] for i, _ in pairs])
    feats = np.concatenate([f for _, f in pairs])
    order = np.lexsort((feats, docs))
    docs, feats = docs[order], feats[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (feats[1:] != feats[:-1])
    return docs[new], feats[new]


def _known_features(w: Words, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of the run, index into the sorted ``features``), each once per text.

    Features are worked out for distinct words only.
    """
    k = len(features)
    if not k or not len(w):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    word, hit = [], []
    for i, f in _word_features(w, first):
        at = np.minimum(np.searchsorted(features, f), k - 1)
        good = np.flatnonzero(features[at] == f)
        word.append(i[good])
        hit.append(at[good])
    word, hit = np.concatenate(word), np.concatenate(hit)
    order = np.argsort(word, kind="stable")
    word, hit = word[order], hit[order]
    begin = np.searchsorted(word, np.arange(len(first) + 1))
    n = np.diff(begin)[inverse]                       # features of each word of the run
    some = np.flatnonzero(n)
    n = n[some]
    at = np.repeat(begin[inverse[some]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    pair = np.unique(np.repeat(w.doc_of()[some], n) * k + hit[at])
    return pair // k, pair % k


def _sample_features(sample: DataFrame, flags: list[str]) -> DataFrame:
    """``(label_id, flags..., features)``: the distinct features of each sampled document."""
    fields = [*sample.schema.fields[:-1], T.StructField("features", T.ArrayType(T.LongType()))]

    def run(batches):
        for b in batches:
            rows = []
            for _, n, data, offsets in slices(b.column(1 + len(flags))):
                doc, feat = _feature_hashes(Words(data, offsets, _MAP))
                bounds = np.searchsorted(doc, np.arange(n + 1))
                rows += [feat[x:y].view(np.int64) for x, y in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(1 + len(flags))), pa.array(rows, pa.list_(pa.int64()))],
                                             [f.name for f in fields])
        trim()
    return sample.mapInArrow(run, T.StructType(fields))


def _select(marked: DataFrame, flag: str, sizes: dict[int, tuple[int, int]], skips: list[tuple[int, ...]], most: int) -> dict[tuple, list[int]]:
    """For each set of folds left out, the ``most`` features whose shares of documents differ most between the labels of
    the other folds, in standard errors. ``sizes``: documents of each fold with and without the flag."""
    folds = sorted(sizes)
    per = marked.select(F.explode("features").alias("f"), flag, "fold").groupBy("f").agg(
        *[x for j in folds for x in (F.sum(F.when(F.col("fold") == j, F.col(flag)).otherwise(0)).alias(f"one{j}"),
                                     F.count(F.when(F.col("fold") == j, 1)).alias(f"all{j}"))])
    each = []
    for i, skip in enumerate(skips):
        left = [j for j in folds if j not in skip]
        n_one, n_zero = (sum(sizes[j][k] for j in left) for k in (0, 1))
        if not n_one or not n_zero:
            continue
        one, every = (sum((F.col(f"{name}{j}") for j in left), F.lit(0)) for name in ("one", "all"))
        p = every / (n_one + n_zero)
        z = F.abs(one / n_one - (every - one) / n_zero) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-9)) * (1 / n_one + 1 / n_zero))
        each.append(F.struct(F.lit(i).alias("i"), F.when(every >= MIN_DOCS, z).alias("z")))
    out: dict[tuple, list[int]] = {skip: [] for skip in skips}
    if each:
        rows = per.select("f", F.inline(F.array(*each))).filter("z is not null")
        best = rows.withColumn("r", F.row_number().over(W.partitionBy("i").orderBy(F.desc("z"), "f"))).filter(F.col("r") <= most)
        for r in best.select("i", "f").collect():
            out[skips[r["i"]]].append(r["f"])
    return out


class Fits:
    """Chains fitted on a sample without some of its folds, with everything learned from the other folds alone.

    ``x``: rows by features, 0 or 1; ``y``: rows by categories; ``chosen``: for each set of folds left out, the columns
    of ``x`` that the other folds choose.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, chosen: dict[tuple, np.ndarray]):
        self.x, self.y, self.weight, self.fold, self.chosen = x, y, weight, fold, chosen
        self.known: dict[tuple, list] = {}

    def chain(self, skip: tuple[int, ...], upto: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Models of categories 0 to ``upto``, learned from rows of no fold in ``skip``: (how telling each chosen feature
        is, weights as ``chain_logits`` takes them). A later model's inputs are out-of-fold logits of the earlier ones."""
        if (skip, upto) not in self.known:
            rows = ~np.isin(self.fold, skip)
            x, y, weight = self.x[rows][:, self.chosen[skip]], self.y[rows], self.weight[rows]
            earlier = np.stack([self.out_of_fold(skip, c)[rows] for c in range(upto)], axis=1) if upto else np.zeros((len(x), 0))
            models = self.chain(skip, upto - 1) if upto else []
            self.known[skip, upto] = [*models, _fit(x, y[:, upto], weight, np.clip(earlier, -CLIP, CLIP))]
        return self.known[skip, upto]

    def out_of_fold(self, skip: tuple[int, ...], category: int) -> np.ndarray:
        """Logits of a category for the rows of no fold in ``skip``, each by a chain that saw neither its fold nor ``skip``."""
        out = np.zeros(len(self.y))
        for k in sorted(set(self.fold.tolist()) - set(skip)):
            less = tuple(sorted((*skip, k)))
            rows = np.flatnonzero(self.fold == k)
            doc, feat = np.nonzero(self.x[rows][:, self.chosen[less]])
            out[rows] = chain_logits(doc, feat, len(rows), self.chain(less, category))[:, category]
        return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One model of a chain, from these rows alone."""
    # each feature counts by its log ratio of shares, so that telling ones are held back less
    one, zero = weight * y, weight * (1 - y)
    ratio = np.log((one @ x + 1) / (one.sum() + 2)) - np.log((zero @ x + 1) / (zero.sum() + 2))
    # one telling feature is enough for a person: the largest ratio present, less its standard error
    sure = np.maximum(ratio - np.sqrt(1 / (one @ x + 1) + 1 / (zero @ x + 1)), 0)
    inputs = np.hstack([x * ratio, (x * sure).max(axis=1, initial=0)[:, None], earlier])
    if len(set(y)) < 2:
        w = np.zeros(inputs.shape[1] + 1)
        w[-1] = 20.0 if len(y) and y.all() else -20.0
    else:
        w = logistic(inputs, y, weight, RIDGE)
    return sure, np.concatenate([w[:len(ratio)] * ratio, w[len(ratio):]])


class Chain:
    """Sorted feature hashes, and per category the weights over (features, earlier logits) and the intercept."""

    def __init__(self, names: list[str], features: np.ndarray, weights: list[np.ndarray]):
        self.names, self.features, self.weights = names, features, weights

    def tables(self):
        return self.names, self.features, self.weights


def chain_logits(doc: np.ndarray, feat: np.ndarray, n: int, models: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Logits ``(n, categories)`` of texts given as pairs (text, feature index).

    A model: how telling each feature is, of which the largest present counts,
    and the weights of features, that largest value, earlier logits and one.
    """
    out = np.zeros((n, len(models)))
    for c, (sure, w) in enumerate(models):
        k = len(sure)
        peak = np.zeros(n)
        np.maximum.at(peak, doc, sure[feat])
        out[:, c] = (w[-1] + np.bincount(doc, weights=w[feat], minlength=n)[:n] + w[k] * peak
                     + np.clip(out[:, :c], -CLIP, CLIP) @ w[k + 1:k + 1 + c])
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, doc_id: str = "doc_id", text: str = "text",
          sample_docs: int = SAMPLE_DOCS, most_features: int = FEATURES) -> Chain:
    """A chain over ``categories`` (name -> condition on ``labels``), in order.

    Only the bounded sample reaches the driver, as lists of the chosen
    features. A category with one label only gets a constant model. Earlier logits that a later model learns from are
    out of fold throughout: choice of features, their weights and the model all come from the other folds.
    """
    names = list(categories)
    flags = [f"flag{i}" for i in range(len(names))]
    known = clear_labels(labels, doc_id, **dict(zip(flags, categories.values(), strict=True)))
    picked, counts = sample_ids(known, flags, sample_docs, SEED)
    texts = docs.select(q(doc_id).alias("label_id"), F.coalesce(q(text).cast("string"), F.lit("")).cast("binary").alias("raw"))
    fold = F.pmod(F.xxhash64(F.lit(SEED), "raw"), F.lit(FOLDS)).cast("int")  # equal texts share a fold
    sample = texts.join(F.broadcast(picked), "label_id").select("label_id", *flags, fold.alias("fold"), "raw")
    marked = _sample_features(sample, [*flags, "fold"]).persist()
    # the sets of folds that a chain so long leaves out of some model
    skips = [s for n in range(len(names)) for s in combinations(range(FOLDS), n)]
    try:
        y_rows = marked.select("fold", *flags).collect()
        chosen: dict[tuple, set[int]] = {s: set() for s in skips}
        for i, f in enumerate(flags):
            sizes = {j: (sum(r[1 + i] for r in y_rows if r[0] == j), sum(1 - r[1 + i] for r in y_rows if r[0] == j)) for j in range(FOLDS)}
            for s, found in _select(marked, f, sizes, skips, most_features).items():
                chosen[s] |= set(found)
        every = sorted(set().union(*chosen.values()))
        features = np.array(sorted(np.array(every, dtype=np.int64).view(np.uint64)), dtype=np.uint64)
        signed = features.view(np.int64).tolist()
        has = F.array_intersect("features", F.array(*[F.lit(x) for x in signed]) if len(signed) < 2 else F.from_json(
            F.lit(str(signed)), "array<bigint>"))
        rows = marked.select("label_id", "fold", *flags, has.alias("has")).orderBy("label_id", *flags).collect()
    finally:
        marked.unpersist()
    place = lambda v: np.searchsorted(features, np.array(sorted(v), dtype=np.int64).view(np.uint64))
    x = np.zeros((len(rows), len(features)), dtype=np.float32)
    for r, row in enumerate(rows):
        x[r, place(row["has"])] = 1
    y = np.array([[row[f] for f in flags] for row in rows], dtype=float).reshape(len(rows), len(flags))
    # each combination of labels weighs as much as among all labelled rows
    combos = [tuple(int(v) for v in r) for r in y]
    held = {c: combos.count(c) for c in set(combos)}
    weight = np.array([counts[c] / held[c] for c in combos])
    weight = weight / weight.mean() if len(weight) else weight
    columns = {s: np.sort(place(v)) for s, v in chosen.items()}
    fits = Fits(x, y, weight, np.array([row["fold"] for row in rows], dtype=np.int64), columns)
    return Chain(names, features[columns[()]], fits.chain((), len(names) - 1) if names else [])


def score(docs: DataFrame, chain: Chain, *, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Rows of ``docs`` with a probability per category; returns the frame and the added names by category."""
    names = dict(zip(chain.names, fresh(docs, *[f"p_{n}" for n in chain.names]), strict=True))
    (raw,) = fresh(docs, "toxicity_text")
    rows = docs.withColumn(raw, F.coalesce(q(text).cast("string"), F.lit("")).cast("binary"))
    kept, shared = list(docs.columns), docs.sparkSession.sparkContext.broadcast(chain.tables())

    def run(batches):
        _, features, weights = shared.value
        for b in batches:
            parts = [chain_logits(*_known_features(Words(data, offsets, _MAP), features), n, weights)
                     for _, n, data, offsets in slices(b.column(len(kept)))]
            if parts:
                p = sigmoid(np.vstack(parts))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), *(pa.array(p[:, c].copy()) for c in range(p.shape[1]))],
                                                 [*kept, *names.values()])
        trim()
    schema = T.StructType([*docs.schema.fields, *(T.StructField(names[n], T.DoubleType()) for n in chain.names)])
    return rows.mapInArrow(run, schema), names


def predict_toxicity(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], *, doc_id: str = "doc_id",
                     text: str = "text", **options) -> tuple[DataFrame, dict[str, str]]:
    """Trains the chain on the labelled documents and scores every row of ``docs``.

    Defined results: null, empty and wordless texts get the intercepts'
    probabilities; whole texts are read; repeated rows get equal scores; an empty table gives an empty result; labels that
    are null, contradict each other or lack a document are not learned from;
    with no labels at all every probability is next to 0; added columns are renamed if ``docs`` has them.
    """
    return score(docs, train(docs, labels, categories, doc_id=doc_id, text=text, **options), text=text)


def op5_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    # the labels table marks two kinds: junk (quality 0) and toxic
    out, names = predict_toxicity(docs, labels, {"junk": 1 - F.col("quality"), "toxic": F.col("toxic")})
    return out.select("doc_id", q(names["junk"]).alias("p_junk"), q(names["toxic"]).alias("p_toxic"),
                      (q(names["toxic"]) >= THRESHOLD).alias("toxic"))
