"""Secret scans: fixed patterns plus character Markov models (operator 9).

Two first-order character models are trained from labelled samples: random
strings (the values the patterns find) and ordinary identifiers (words of the
texts the patterns leave alone). A candidate run of key-like characters is a
secret if its log-likelihood ratio per character, random against ordinary, is above a
threshold. Only DataFrame functions are used.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, hash_share, q, read

#: The patterns, the group whose length counts, its least length.
KINDS = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
MODEL_KIND = "markov"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Words that may serve as ordinary identifiers.
IDENTIFIER = r"[A-Za-z0-9_-]{6,}"
#: A whole run of key-like characters that may be a key: it has digits and letters. Not taken for an identifier.
UNSURE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
#: Bound of the sample of ordinary texts: about this many, by hash of the row.
SAMPLE_DOCS = 2_000
THRESHOLD = 0.4   # nats per character
CODES = 128


def _quick(kind: str) -> str:
    """A pattern that any text with an accepted match matches (cheaper than finding all)."""
    return {"access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}.get(kind, dict((k, p) for k, p, _, _ in KINDS)[kind])


def running(values: Column, joined) -> Column:
    """Running totals of an array: ``joined`` (sum, or another associative operation) of each element and all before it.

    By doubling: after k steps an element covers the 2**k elements up to it, so an array of n takes log2(n) linear
    steps (an ``aggregate`` that appends would copy the array n times).
    """
    rounds = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")))

    def step(acc, k):
        hop = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(acc))
        back = F.concat(F.array_repeat(F.lit(None).cast("int"), hop), F.slice(acc, F.lit(1), F.size(acc) - hop))
        return F.zip_with(acc, back, lambda x, y: F.when(y.isNull(), x).otherwise(joined(x, y)))
    return F.aggregate(rounds, values, step)


def spans_of(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Accepted matches of one pattern: array of (start, order, end, kind, value), code points.

    The pieces between the matches and the matches themselves add up to the
    text, so running lengths give the positions.
    """
    gaps, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    sizes = F.transform(found, lambda m: F.length(m))
    # the piece after the last match has none behind it
    ends = running(F.zip_with(F.slice(F.transform(gaps, lambda g: F.length(g)), F.lit(1), F.size(found)), sizes, lambda g, m: g + m),
                   lambda x, y: x + y)
    spans = F.transform(F.arrays_zip(ends.alias("e"), sizes.alias("n"), value.alias("v")), lambda x: F.struct(
        (x["e"] - x["n"]).alias("start"), F.lit(order).alias("order"), x["e"].alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
    return F.filter(spans, lambda s: F.length(s["value"]) >= least)


SPANS = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPANS)
    parts = [F.when(text.rlike(_quick(k)), spans_of(text, k, i, p, g, n)).otherwise(none)
             for i, (k, p, g, n) in enumerate(KINDS)]
    return F.sort_array(F.concat(*parts))


def join_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _codes(token: Column) -> Column:
    """Character pairs of a text of ASCII characters as first * CODES + second, in one pass."""
    each = F.transform(F.split(token, ""), lambda c: F.ascii(c))
    n = F.size(each)
    return F.zip_with(F.slice(each, F.lit(1), n - 1), F.slice(each, F.lit(2), n - 1), lambda a, b: a * CODES + b)


def _pairs(strings: DataFrame, name: str) -> DataFrame:
    """Counts of character pairs: (code, count). ``strings`` has one column s."""
    pairs = strings.filter(F.length("s") >= 2).select(F.explode(_codes(F.col("s"))).alias("code"))
    return pairs.groupBy("code").agg(F.count("*").alias(name))


def clear_of(spans: Column, base: Column) -> Column:
    """The spans that overlap none of ``base``.

    Both are put in one order: a base span where it begins, another span where it ends. On the way the furthest end
    of the base spans so far is kept, and a span is clear if that does not reach beyond its start.
    """
    events = F.sort_array(F.concat(
        F.transform(spans, lambda s: F.struct(s["end"].alias("at"), F.lit(0).alias("kind"), s["start"].alias("start"), F.lit(0).alias("reach"))),
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("kind"), b["start"].alias("start"), b["end"].alias("reach")))))
    reach = running(F.transform(events, lambda e: e["reach"]), lambda x, y: F.greatest(x, y))
    verdicts = F.zip_with(events, reach, lambda e, r: F.struct(e["at"].alias("at"), e["kind"].alias("kind"), (r <= e["start"]).alias("clear")))
    # spans are in order and do not overlap each other: their verdicts come in the same order
    clear = F.filter(verdicts, lambda v: v["kind"] == 0)
    both = F.zip_with(spans, clear, lambda s, v: F.struct(s.alias("span"), v["clear"].alias("clear")))
    return F.transform(F.filter(both, lambda x: x["clear"]), lambda x: x["span"])


def train(docs: DataFrame, text: str, doc_id: str, sample_docs: int = SAMPLE_DOCS) -> list[float]:
    """Log-likelihood ratio per character pair, as CODES * CODES doubles.

    Labelled random: the values of all accepted spans. Labelled ordinary: the
    identifiers of texts without spans, from a bounded sample of texts by hash;
    runs that might be keys themselves (see ``UNSURE``) are left out.
    Both models are smoothed by one count per character of the key alphabet.
    """
    body = F.coalesce(q(text), F.lit(""))
    secrets = docs.select(F.explode(F.transform(base_spans(body), lambda s: s["value"])).alias("s"))
    few = docs.filter(hash_share(F.xxhash64(F.lit(9), q(doc_id), q(text)), sample_docs, docs.count()))
    plain = few.filter(F.size(base_spans(body)) == 0).select(F.explode(F.regexp_extract_all(
        F.regexp_replace(body, UNSURE, " "), F.lit(IDENTIFIER), F.lit(0))).alias("s"))
    both = _pairs(secrets, "r").join(_pairs(plain, "o"), "code", "full")
    return llr_table({row[0]: (row[1] or 0, row[2] or 0) for row in both.collect()})  # at most CODES * CODES rows


#: The key alphabet: characters a candidate can hold.
ALPHABET = [c for c in range(CODES) if chr(c).isascii() and (chr(c).isalnum() or chr(c) in "+/_=-")]


def llr_table(counts: dict[int, tuple[int, int]]) -> list[float]:
    """log P(random) - log P(ordinary) of each character pair, from pair counts."""
    out = [0.0] * (CODES * CODES)
    for a in ALPHABET:
        rows = [counts.get(a * CODES + b, (0, 0)) for b in ALPHABET]
        rt, ot = sum(r for r, _ in rows) + len(ALPHABET), sum(o for _, o in rows) + len(ALPHABET)
        for b, (r, o) in zip(ALPHABET, rows, strict=True):
            out[a * CODES + b] = math.log((r + 1) / rt) - math.log((o + 1) / ot)
    return out


def scan_secrets(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> tuple[DataFrame, str, str]:
    """Rows of ``docs`` with the base spans and all spans; returns (frame, base column, all column).

    Spans are arrays of (start, order, end, kind, value), sorted by start, then kind.
    A candidate counts if it overlaps no base span. With no labelled random string at all the
    models say nothing and only the base spans are given.

    Defined results: a null or empty text has no spans; repeated rows are
    scanned alike; an empty table gives an empty result; added columns are
    renamed if ``docs`` has them.
    """
    base, every, found = fresh(docs, "base_spans", "spans", "secret_candidates")
    body = F.coalesce(q(text), F.lit(""))
    scanned = docs.withColumn(base, base_spans(body))
    table = train(docs, text, doc_id)
    if not any(table):
        return scanned.withColumn(every, q(base)), base, every
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")  # folded to one constant

    def likely(token):
        # constants are folded, and an array constant is looked up in place
        total = F.aggregate(_codes(token), F.lit(0.0), lambda acc, code: acc + F.get(ratios, code))
        return total > threshold * (F.length(token) - 1)

    # most texts have no likely candidate: positions are only worked out where one is
    out = scanned.withColumn(found, F.exists(F.regexp_extract_all(body, F.lit(CANDIDATE), F.lit(0)), likely))
    spans = F.filter(spans_of(body, MODEL_KIND, len(KINDS), CANDIDATE, 0, 16), lambda s: likely(s["value"]))
    out = out.withColumn(every, F.when(q(found), F.sort_array(F.concat(q(base), clear_of(spans, q(base))))).otherwise(q(base)))
    return out.drop(found), base, every


def op9_secrets(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out, base, every = scan_secrets(docs)
    count = lambda kind: F.size(F.filter(q(base), lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k, _, _, _ in KINDS],
                      F.sha2(join_spans(q(base)), 256).alias("base_sha256"), join_spans(q(every)).alias("spans"))
