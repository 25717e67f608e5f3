"""Mixing sources to target weights (operator 1).

Every document gets a hash-random key. Within a source the documents are put
in key order by cutting the key space into equal ranges (the key is uniform,
so ranges hold equal numbers of rows, however large the source), a prefix sum
of words runs over the ranges, and a second one inside each range. The source's
budget then cuts that order at an exact word: whole epochs first, then the
documents before the cut, the one at the cut in part.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_step, fresh, n_words, parts_for, q, random_key, read, small, stored

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)     # the mix holds 3/2 of all words
MAX_EPOCHS = 2
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights: Sequence[int] | Mapping, share=SHARE, max_epochs=MAX_EPOCHS) -> DataFrame:
    """``(source, size)`` -> adds ``weight``, ``target``: one row per source.

    Sources are ordered by code point, null last; a sequence of weights repeats
    over that order, a mapping names them (sources it lacks weigh 0). Targets
    are shares of ``share`` times all words, held at ``max_epochs`` times the
    source; the excess goes to the others by weight until none is above (the
    level at which all capped shares add up to the total, found directly).
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    if isinstance(weights, Mapping):
        w = F.lit(0)
        for name, v in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(int(v))).otherwise(w)
    else:
        ring = F.array(*[F.lit(int(x)) for x in weights])
        w = F.element_at(ring, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    num, den = share
    t = sizes.select("source", "size", w.cast("long").alias("weight"))
    t = t.withColumn("cap", F.col("size") * max_epochs)
    t = t.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")))
    live = F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)
    cap = F.when(F.col("weight") > 0, F.col("cap")).otherwise(0)
    everything = W.partitionBy()
    by_ratio = W.orderBy("ratio")
    t = t.select("*", F.sum("size").over(everything).alias("total"),
                 F.sum(live).over(everything).alias("all_w"),
                 F.sum(live).over(by_ratio.rangeBetween(W.unboundedPreceding, 0)).alias("w_upto"),
                 F.sum(cap).over(by_ratio.rangeBetween(W.unboundedPreceding, 0)).alias("c_upto"),
                 F.sum(live).over(W.partitionBy("ratio")).alias("w_tie"),
                 F.sum(cap).over(W.partitionBy("ratio")).alias("c_tie"))
    # the level if every source of a smaller ratio is held at its cap
    c_below = F.col("c_upto") - F.col("c_tie")
    w_rest = F.col("all_w") - F.col("w_upto") + F.col("w_tie")
    level = (num * F.col("total") - den * c_below) / (den * w_rest)
    t = t.withColumn("level", F.when((F.col("weight") > 0) & (level <= F.col("ratio")), level))
    # supposing too many sources at their caps leaves a lower level for the rest: the highest is the true one
    t = t.withColumn("level", F.max("level").over(everything))
    raw = F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    target = F.when(F.col("weight") > 0, F.least(raw, F.col("cap").cast("double"))).otherwise(F.lit(0.0))
    return t.select("source", "size", "weight", target.alias("target"))


def mix_sources(docs: DataFrame, *, text: str = "text", source: str = "source", doc_id: str = "doc_id",
                weights: Sequence[int] | Mapping = WEIGHTS, share=SHARE, max_epochs: int = MAX_EPOCHS,
                seed: str = SEED, size: Column | None = None) -> tuple[DataFrame, dict[str, str]]:
    """All rows of ``docs`` with the words the mix takes of each.

    Returns the frame and the names of the added columns under ``size``,
    ``source_size``, ``target`` and ``taken`` (renamed if ``docs`` has them).

    Defined results: a null or wordless text has size 0 and takes 0; a null
    source is a source of its own, last in order; repeated rows each count;
    ties of the key (repeated ids) are ordered by id and size, and rows that tie
    on all of these are alike to the mix; an empty table gives an empty result. A source's taken words are its target
    rounded to a whole word; no document is taken more than ``max_epochs``
    times. Other columns are carried along unread.
    """
    names = dict(zip(("size", "source_size", "target", "taken", "key", "cut", "src", "of_src", "of", "before", "budget"),
                     fresh(docs, "size", "source_size", "target", "taken", "mix_key", "mix_cut", "mix_src",
                           "mix_src_of", "mix_cut_of", "mix_before", "mix_budget"), strict=True))
    n = names.__getitem__
    n_rows = docs.count()
    step = cut_step(n_rows)
    rows = docs.withColumns({n("size"): size if size is not None else n_words(q(text)),
                             n("key"): random_key(seed, q(doc_id), F.md5(F.coalesce(q(text), F.lit("")).cast("binary")))})
    # join and window go by the same two columns, so that rows are dealt out once
    src = F.coalesce(F.concat(F.lit("s"), q(source).cast("string")), F.lit("n"))
    rows = rows.withColumns({n("cut"): F.expr(f"`{n('key')}` div {step}L"), n("src"): src})

    # words per (source, range): one small row each, added up before the shuffle
    cuts = rows.groupBy(q(source).alias("source"), q(n("cut")).alias("cut")).agg(F.sum(q(n("size"))).alias("words"))
    sizes = cuts.groupBy("source").agg(F.sum("words").alias("size"))
    goal = source_targets(sizes, weights, share, max_epochs)
    goal = goal.withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    before = W.partitionBy("source").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
    cuts = cuts.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    cuts = cuts.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(
        F.coalesce(F.concat(F.lit("s"), F.col("c.source").cast("string")), F.lit("n")).alias(n("of_src")), F.col("c.cut").alias(n("of")), F.col("before").alias(n("before")),
        F.col("g.size").alias(n("source_size")), F.col("target").alias(n("target")), F.col("budget").alias(n("budget")))

    cuts = stored(cuts, parts_for(n_rows, 5_000_000))
    joined = rows.join(small(cuts, cuts.count()), (q(n("src")) == q(n("of_src"))) & (q(n("cut")) == q(n("of"))))
    inside = (W.partitionBy(q(n("src")), q(n("cut"))).orderBy(q(n("key")), q(doc_id), q(n("size")))
              .rowsBetween(W.unboundedPreceding, -1))
    first = q(n("before")) + F.coalesce(F.sum(q(n("size"))).over(inside), F.lit(0))
    whole = F.when(q(n("source_size")) > 0, F.expr(f"`{n('budget')}` div `{n('source_size')}`")).otherwise(0)
    rest = q(n("budget")) - whole * q(n("source_size"))
    part = F.least(F.greatest(rest - first, F.lit(0)), q(n("size")))
    out = joined.withColumn(n("taken"), (whole * q(n("size")) + part).cast("long"))
    keep = [q(c) for c in docs.columns]
    return out.select(*keep, *[q(n(x)) for x in ("size", "source_size", "target", "taken")]), \
        {k: names[k] for k in ("size", "source_size", "target", "taken")}


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, same columns as ``docs``.

    A document at a source's cut appears once more with its first words only
    (to the end of the last word taken; ``n_chars``, where there is such a column, follows). Wordless
    documents hold no words and are not part of a mix.
    """
    text = options.get("text", "text")
    out, n = mix_sources(docs, **options)
    size, taken = q(n["size"]), q(n["taken"])
    copies = F.expr(f"transform(sequence(1, cast(ceil(`{n['taken']}` / `{n['size']}`) as int)), "
                    f"i -> least(`{n['size']}`, `{n['taken']}` - (i - 1) * `{n['size']}`))")
    (words,) = fresh(out, "copy_words")
    out = out.filter((size > 0) & (taken > 0)).withColumn(words, F.explode(copies))
    # split() keeps white space before each following word; a look-behind pattern would be slower
    pieces = F.split(q(text), r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.concat_ws("", F.slice(pieces, F.lit(1), q(words).cast("int")))
    out = out.withColumn(text, F.when(q(words) < size, cut).otherwise(q(text)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(q(words) < size, F.length(q(text))).otherwise(q("n_chars")).cast(kind))
    return out.select(*[q(c) for c in docs.columns])


def op1_mix(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out, n = mix_sources(docs)
    return out.select("doc_id", "source", q(n["size"]).alias("size"), q(n["source_size"]).alias("source_size"),
                      q(n["target"]).alias("target"), q(n["taken"]).alias("taken"))


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((rk - 1) % 3 + 1)::INT]::BIGINT AS weight, (SELECT sum(size) FROM s)::BIGINT AS total FROM s),
r AS (SELECT *, 2 * size AS cap, (2 * size)::DOUBLE / weight AS ratio FROM w),
-- the excess over the caps is shared again until none is above: the level rises round by round
rounds(k, lev) AS (
  SELECT 0, (SELECT (3 * any_value(total))::DOUBLE / (2 * sum(weight))::DOUBLE FROM r)
  UNION ALL
  SELECT k + 1, (SELECT (3 * any_value(total) - 2 * coalesce(sum(cap) FILTER (ratio < lev), 0))::DOUBLE
                        / (2 * sum(weight) FILTER (ratio >= lev))::DOUBLE FROM r)
  FROM rounds WHERE k < (SELECT count(*) FROM r)),
l AS (SELECT max(lev) AS lev FROM rounds),
t AS (SELECT source, size AS source_size, least(lev * weight, cap::DOUBLE) AS target FROM r, l),
x AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, source, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (budget // source_size) * size
             + least(greatest(budget % source_size - first, 0), size) ELSE 0 END)::BIGINT AS taken
FROM x
"""
