"""Document fingerprints by consistent weighted sampling (operator 12).

A text is a bag of words, each weighing as often as it occurs. For every
sample a word draws, from its own hash alone, two gamma variables r and c and
a uniform b; with weight w it gets t = floor(ln w / r + b) and the value
ln a = ln c - r (t - b) - r. The word of smallest value and its t are the
sample. Two bags agree in a sample with a probability equal to their
generalised Jaccard similarity (sum of smaller weights over sum of larger).

Only DataFrame functions are used; sampling runs in generated code.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.buckets import with_count_below
from .common import fresh, q, read, stored

SAMPLES = 64
#: Samples worked out together, in one row of a word: few enough that the generated method is compiled by the JVM.
CHUNK = 4
SEED = 12
_WHITE = " \t\n\x0b\f\r"
#: A sample is kept in 24 bits; different samples share them once in 16 million.
SAMPLE_BITS = 24
_VALUE_SHIFT, _VALUE_SCALE = 200.0, float(1 << 30)  # values lie between -140 and 6: 38 bits in steps of 1e-9
#: A word of weight w has a value a of at least (1 - p') p / w (from its draws, without a logarithm), and the smallest
#: value of a text of n words is above LIMIT / n once in exp(LIMIT) samples, nine million. So a word whose bound is
#: above that is not worked out; a sample left without any word takes the smallest mark, so it too depends on the text alone.
LIMIT = 16.0
_NONE = 1 << 62  # above all packed values

#: Cuts of the id order hold about this many rows, and there are at most so many.
ROWS_PER_CUT, MOST_CUTS = 500, 65_536


def _uniform(bits: Column, n: int) -> Column:
    """``n`` bits (as a long) -> (0, 1)."""
    return (bits.cast("double") + F.lit(0.5)) * F.lit(2.0 ** -n)


def _draws(base: Column, i: int) -> tuple[Column, Column, Column]:
    """Products p and p' of two uniforms each, and a uniform b, of sample ``i`` of a word's chunk hash.

    They give r = -ln p and c = -ln p', gamma(2, 1) both.
    """
    one, two = (F.xxhash64(base, F.lit(2 * i + k)) for k in range(2))
    p = _uniform(F.shiftrightunsigned(one, 42), 22) * _uniform(F.shiftrightunsigned(one, 20).bitwiseAND(F.lit((1 << 22) - 1)), 22)
    p2 = _uniform(F.shiftrightunsigned(two, 32), 32) * _uniform(two.bitwiseAND(F.lit((1 << 32) - 1)), 32)
    return p, p2, _uniform(one.bitwiseAND(F.lit((1 << 20) - 1)), 20)


def _mark(base: Column, i: int, t: Column | int) -> Column:
    t = F.lit(t) if isinstance(t, int) else t
    return F.shiftrightunsigned(base, 5 * i).bitwiseXOR(t).bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1))


def _packed(base: Column, i: int, r: Column, ln_c: Column, b: Column, ln_w: Column) -> Column:
    """Value and sample in one long, so that the smallest one is the sample (null weight: null)."""
    t = F.floor(ln_w / r + b)
    value = F.floor((ln_c - r * (t.cast("double") - b + 1.0) + F.lit(_VALUE_SHIFT)) * F.lit(_VALUE_SCALE))
    return F.shiftleft(value, SAMPLE_BITS).bitwiseOR(_mark(base, i, t))


def words(text: Column) -> Column:
    """Words of a text in lower case; a text without any has the empty word."""
    return F.split(F.btrim(F.lower(text), F.lit(_WHITE)), r"[\x20\x09-\x0D]+")


def weighted_words(rows: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """``keys``, ``term`` (a 64-bit hash) and for each text column its count ``w0``, ``w1``, ... and, where the text has
    the term, the text's number of words ``n0``, ``n1``, ..."""
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), words(q(t)).alias("words")) for i, t in enumerate(texts)]))
    each = rows.select(*[q(k) for k in keys], sides.alias("s")).select(
        *[q(k) for k in keys], F.col("s.side").alias("side"), F.size("s.words").alias("size"), F.explode("s.words").alias("word"))
    each = each.select(*[q(k) for k in keys], F.xxhash64(F.lit(SEED), "word").alias("term"), "side", "size")
    mine = [F.col("side") == i for i in range(len(texts))]
    return each.groupBy(*[q(k) for k in keys], "term").agg(
        *[F.count(F.when(m, 1)).alias(f"w{i}") for i, m in enumerate(mine)], *[F.max(F.when(m, F.col("size"))).alias(f"n{i}") for i, m in enumerate(mine)])


def sketch(rows: DataFrame, keys: list[str], texts: list[str], samples: int = SAMPLES) -> DataFrame:
    """``keys`` and, for each text column (never null), an array of ``samples`` 24-bit samples ``s0``, ``s1``, ...

    ``keys`` tell the rows apart and none is called term, side, word, size, words, chunk, base, most, or a letter and a number. If the rows are
    already partitioned by one of them, nothing is shuffled. A text takes its task one word at a time, so its length
    does not matter, and a row leaves a task as ``samples`` numbers.
    """
    if samples % CHUNK:
        raise ValueError(f"samples must be a multiple of {CHUNK}")
    sides, chunks = range(len(texts)), samples // CHUNK
    key = [q(k) for k in keys]
    bags = weighted_words(rows, keys, texts).select(
        *key, F.explode(F.array(*[F.lit(j) for j in range(chunks)])).alias("chunk"), "term",
        *[F.log(F.col(f"w{s}").cast("double")).alias(f"w{s}") for s in sides],  # null where the text lacks the word
        *[(F.lit(LIMIT) * F.col(f"w{s}") / F.col(f"n{s}")).alias(f"l{s}") for s in sides])
    limits = [F.col(f"l{s}") for s in sides]
    bags = bags.withColumns({"base": F.xxhash64("term", "chunk"), "most": F.greatest(*limits) if len(sides) > 1 else limits[0]})
    # draws, then logarithms of those that may count, then values: columns of their own, so that all texts share them
    about = [*key, "chunk", "base", "most", *[f"w{s}" for s in sides], *[f"l{s}" for s in sides]]
    drawn = [c.alias(f"{x}{i}") for i in range(CHUNK) for x, c in zip(("p", "c", "b"), _draws(F.col("base"), i), strict=True)]
    bags = bags.select(*about, *drawn)
    bound = [(F.lit(1.0) - F.col(f"c{i}")) * F.col(f"p{i}") for i in range(CHUNK)]
    bags = bags.select(*about, *[F.col(f"b{i}") for i in range(CHUNK)], *[x.alias(f"u{i}") for i, x in enumerate(bound)],
                       *[F.when(bound[i] <= F.col("most"), -F.log(F.col(f"p{i}"))).alias(f"r{i}") for i in range(CHUNK)],
                       *[F.when(bound[i] <= F.col("most"), F.log(-F.log(F.col(f"c{i}")))).alias(f"c{i}") for i in range(CHUNK)])

    def value(i, s):
        return _packed(F.col("base"), i, F.col(f"r{i}"), F.col(f"c{i}"), F.col(f"b{i}"), F.col(f"w{s}"))

    def best_of(i, s):
        under = F.col(f"u{i}") <= F.col(f"l{s}")  # null where the text lacks the word
        return F.min(F.when(under, value(i, s)).when(~under, F.lit(_NONE).bitwiseOR(_mark(F.col("base"), i, 0)))).alias(f"m{s}_{i}")
    best = [best_of(i, s) for i in range(CHUNK) for s in sides]
    parts = bags.groupBy(*key, "chunk").agg(*best)
    low = F.lit((1 << SAMPLE_BITS) - 1)
    parts = parts.select(
        *key, "chunk", *[F.array(*[q(f"m{s}_{i}").bitwiseAND(low).cast("int") for i in range(CHUNK)]).alias(f"s{s}") for s in sides])
    out = parts.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk", *[f"s{s}" for s in sides]))).alias("parts"))
    return out.select(*key, *[F.flatten(F.col(f"parts.s{s}")).alias(f"s{s}") for s in sides])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples of two sketches: the estimate of their generalised Jaccard similarity."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.size(a)


def as_text(sketch_: Column) -> Column:
    """Six lowercase hex digits for each sample."""
    return F.lower(F.array_join(F.transform(sketch_, lambda x: F.lpad(F.hex(x), 6, "0")), ""))


def fingerprints(docs: DataFrame, *, text: str = "text", samples: int = SAMPLES) -> tuple[DataFrame, str]:
    """Rows of ``docs`` with a column of samples; returns the frame and the column.

    Equal texts have equal fingerprints. Defined results: a null text is an empty one; texts without words are alike
    and share nothing with others; repeated rows are fingerprinted alike; an empty table gives an empty result; the
    added column is renamed if ``docs`` has it.
    """
    row, body, name = fresh(docs, "cws_row", "cws_text", "fingerprint")
    marked = docs.withColumn(row, F.monotonically_increasing_id())
    marks = sketch(marked.select(q(row), F.coalesce(q(text), F.lit("")).alias(body)), [row], [body], samples)
    marks = marks.select(q(row).alias(body), F.col("s0").alias(name))
    return marked.join(marks, marked[row] == marks[body]).select(*[marked[q_] for q_ in _quoted(docs)], marks[name]), name


def _quoted(df: DataFrame) -> list[str]:
    return ["`" + c.replace("`", "``") + "`" for c in df.columns]


def _array(values: list, kind: str) -> Column:
    """A constant array (folded when the plan is made; createDataFrame would start Python workers)."""
    return F.from_json(F.lit("[" + ",".join(str(v) for v in values) + "]"), f"array<{kind}>")


def beside_next(docs: DataFrame, doc_id: str, text: str, rows_per_cut: int = ROWS_PER_CUT) -> DataFrame:
    """``(cut, pos, ghost, doc_id, body, after)``: every text beside that of the next document by ascending id.

    The id order is cut into ranges of about ``rows_per_cut`` rows; one exchange by cut brings neighbours together.
    The first row of a cut is also sent, as a ``ghost``, to the end of the cut before (that of the first cut to the
    last one), so the last row of a cut finds its next too. Null ids come first. Rows that share an id follow each
    other in the order of a hash: of the text, or, if an id (or null) has more rows than a cut, of the text and the
    row's place in a stored copy of the two columns; such an id is cut by that hash, equal rows included.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(q(doc_id).alias("doc_id"), F.coalesce(q(text).cast("string"), F.lit("")).alias("body"))
    n = docs.count()
    cuts = min(MOST_CUTS, max(1, n // rows_per_cut))
    found = rows.agg(F.count("doc_id"), F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)] or [0.5], max(10_000, 4 * cuts))).first()
    times, nulls = Counter(found[1] or []), (n - found[0]) // rows_per_cut
    edges = sorted(times) if cuts > 1 else []
    hot = nulls > 1 or cuts > 1 and any(v > 1 for v in times.values())
    if hot:  # places must stay the same wherever the rows are read
        rows = stored(rows.withColumn("tie", F.xxhash64("body", F.monotonically_increasing_id())))
    else:
        rows = rows.withColumn("tie", F.xxhash64("body"))
    rows = rows.withColumn("tie", F.shiftrightunsigned("tie", 1))
    of = with_count_below(rows, F.col("doc_id"), edges, "range", strict=False)
    part = F.lit(0)
    if hot:
        share = F.shiftright(F.col("tie"), 10).cast("double") * F.lit(2.0 ** -53)  # [0, 1), rising with tie
        if edges:
            at = F.when(F.col("range") > 0, F.col("range"))  # the edge at or below the id
            many, edge = F.element_at(_array([times[e] for e in edges], "int"), at), F.element_at(_array(edges, kind), at)
            part = F.when(many > 1, F.when(edge == F.col("doc_id"), F.floor(share * many)).otherwise(many)).otherwise(0)
        part = F.when(F.col("doc_id").isNull(), F.floor(share * max(1, nulls))).otherwise(part)
    of = of.withColumn("cut", (F.coalesce(F.col("range"), F.lit(-1)) + 1).cast("long") * (1 << 20) + part.cast("long")).drop("range")

    first = of.groupBy("cut").agg(F.min(F.struct("doc_id", "tie")).alias("f"))  # a row for each cut: at most 2 * MOST_CUTS
    order = W.orderBy("cut")
    last = F.max("cut").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    first = first.select(F.col("cut").alias("of_cut"), "f", F.coalesce(F.lag("cut").over(order), last).alias("before"))
    own, ghost = F.struct("cut", F.lit(0).alias("ghost")), F.struct(F.col("before").alias("cut"), F.lit(1).alias("ghost"))
    is_first = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("tie") == F.col("f.tie"))
    homes = F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own)))
    sent = of.join(F.broadcast(first), F.col("cut") == F.col("of_cut"), "left").select(
        homes.alias("home"), "doc_id", "tie", "body").select("home.cut", "home.ghost", "doc_id", "tie", "body")
    sent = sent.repartition(cuts, "cut")  # as many tasks as cuts: what a task holds does not grow with the table
    inside = W.partitionBy("cut").orderBy("ghost", "doc_id", "tie")
    return sent.select("cut", F.row_number().over(inside).alias("pos"), "ghost", "doc_id", "body", F.lead("body").over(inside).alias("after"))


def compare_edited(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES,
                   rows_per_cut: int = ROWS_PER_CUT) -> DataFrame:
    """Each document's fingerprint beside that of an edited text and of the next document (by ascending id, which must be numeric).

    The edited text's last quarter of code points (rounded down) is replaced by the first as many, or all, of the next
    document; after the last comes the first. Columns: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.

    Defined results: null texts are empty; a lone document is its own next; null ids come first and rows that share an
    id are documents of their own, in a fixed order (see ``beside_next``); an empty table gives an empty result; other
    columns are not read.
    """
    rows = beside_next(docs, doc_id, text, rows_per_cut)
    n = F.char_length("body")
    quarter = F.expr("cast(char_length(body) div 4 as int)")
    edited = F.concat(F.substring("body", F.lit(1), n - quarter), F.substring(F.coalesce("after", F.lit("")), F.lit(1), quarter))
    rows = rows.select("cut", "pos", "ghost", "doc_id", n.cast("long").alias("n_chars"), "body", edited.alias("edited"))
    marks = sketch(rows, ["cut", "pos"], ["body", "edited"], samples)
    marks = marks.select("cut", "pos", "s0", "s1", F.lead("s0").over(W.partitionBy("cut").orderBy("pos")).alias("s2"))
    marks = marks.select(F.col("cut").alias("of_cut"), F.col("pos").alias("of_pos"), as_text(F.col("s0")).alias("fingerprint"),
                         as_text(F.col("s1")).alias("edited_fingerprint"), likeness(F.col("s0"), F.col("s1")).alias("near_edited"),
                         likeness(F.col("s0"), F.col("s2")).alias("near_next"))
    about = rows.filter("ghost = 0").select("cut", "pos", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    return about.join(marks, (F.col("cut") == F.col("of_cut")) & (F.col("pos") == F.col("of_pos"))).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op12_cws(spark, sf_dir):
    return compare_edited(read(spark, sf_dir, "documents"))
