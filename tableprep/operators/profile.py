"""Column profiles: A1-A7, A10.

``column_stats`` profiles ALL requested columns with one wide aggregate
(counts, mean, std, min, max) plus one ``stack`` + ``groupBy(column, value)``
for distinct counts and most frequent values, and the exact quantile search
(see ``functions.quantiles``) -- never a job per column. Histograms are two
passes (range, then bucket counts right-joined to the bucket list so empty
buckets are kept).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.buckets import count_below
from ..functions.category_table import open_table
from ..functions.quantiles import exact_quantiles
from ..functions.timeutil import epoch_micros, from_epoch_micros
from ..ltypes import CATEGORICAL, LType, category_source, field_of, ltypes
from ..names import qcol
from ..table import Table

STATS_SCHEMA = T.StructType([
    T.StructField("column", T.StringType()), T.StructField("ltype", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
    T.StructField("mean", T.DoubleType()), T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()), T.StructField("q25", T.DoubleType()),
    T.StructField("q50", T.DoubleType()), T.StructField("q75", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("unique", T.LongType()), T.StructField("top", T.StringType()),
    T.StructField("top_count", T.LongType()),
    T.StructField("first", T.TimestampNTZType()), T.StructField("last", T.TimestampNTZType()),
])


def column_stats(x, columns=None, exact: bool = True) -> DataFrame:
    """A1-A3 (+A7): one row per column. Numeric: mean, sample std, min,
    25/50/75 centiles (linear), max. Text/categorical/datetime: distinct
    count, most frequent value (ties: smallest) and its count; datetime also
    first/last. All: rows, missing count and share (in %)."""
    t = Table.of(x)
    df = t.df
    lt = ltypes(df)
    cols = list(columns) if columns is not None else t.columns
    num = [c for c in cols if lt[c] == LType.NUMERIC]
    other = [c for c in cols if lt[c] in (LType.STRING, LType.NOMINAL, LType.ORDINAL, LType.DATETIME)]
    dts = [c for c in cols if lt[c] == LType.DATETIME]
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        aggs.append(F.count(qcol(c)).alias(f"n{i}"))
    for i, c in enumerate(num):
        x_ = qcol(c).cast("double")
        aggs += [F.avg(x_).alias(f"mean{i}"), F.stddev_samp(x_).alias(f"std{i}"),
                 F.min(x_).alias(f"min{i}"), F.max(x_).alias(f"max{i}")]
    for i, c in enumerate(dts):
        aggs += [F.min(qcol(c)).alias(f"first{i}"), F.max(qcol(c)).alias(f"last{i}")]
    qspec = {c: [0.25, 0.5, 0.75] for c in num}
    row = df.agg(*aggs).collect()[0]
    rows = row["__rows"]
    if rows == 0:
        raise SchemaError("column_stats: empty table")
    counts = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    q = {}
    if num and exact:
        # count, min and max of this aggregate start the exact search
        pre = {c: (counts[c], row[f"min{i}"], row[f"max{i}"]) for i, c in enumerate(num)}
        q = exact_quantiles(df, qspec, prefetched=pre)
    elif num:
        r2 = df.agg(*[F.percentile_approx(qcol(c).cast("double"), [0.25, 0.5, 0.75], 10_000)
                      .alias(f"q{i}") for i, c in enumerate(num)]).collect()[0]
        q = {c: r2[f"q{i}"] or [None] * 3 for i, c in enumerate(num)}
    top = {}
    if other:
        top = {r["column"]: r for r in value_summary(df, other).collect()}
    out = []
    for c in cols:
        miss = rows - counts[c]
        rec = {"column": c, "ltype": lt[c].value, "rows": rows, "missing": miss,
               "missing_pct": 100.0 * miss / rows}
        if c in num:
            i = num.index(c)
            rec.update(mean=row[f"mean{i}"], std=row[f"std{i}"], min=row[f"min{i}"], max=row[f"max{i}"],
                       q25=q[c][0], q50=q[c][1], q75=q[c][2])
        if c in other:
            s = top.get(c)
            rec.update(unique=s["unique"] if s else 0, top=s["top"] if s else None,
                       top_count=s["top_count"] if s else None)
        if c in dts:
            i = dts.index(c)
            rec.update(first=row[f"first{i}"], last=row[f"last{i}"])
        out.append(tuple(rec.get(f.name) for f in STATS_SCHEMA.fields))
    return df.sparkSession.createDataFrame(out, STATS_SCHEMA)


def stacked_values(df: DataFrame, cols) -> DataFrame:
    """(column, value) long form of ``cols`` as text, missing dropped."""
    arr = F.array(*[F.struct(F.lit(c).alias("column"), qcol(c).cast("string").alias("value"))
                    for c in cols])
    return df.select(F.inline(arr)).where(qcol("value").isNotNull())


#: Most tied values whose texts are fetched by a broadcast join; more are fetched by a shuffled one.
TIES = 100_000


def value_summary(df: DataFrame, cols) -> DataFrame:
    """Per column: distinct count, most frequent value and its count (ties:
    smallest value). Values are counted by 128-bit hashes of their text (map-side,
    so a hot value collapses before the shuffle): what is shuffled does not depend
    on how long the texts are. Only then the texts of the most frequent values
    are fetched, where they stand, and compared; where all values of a column are
    equally frequent the winner is its smallest value and nothing is fetched."""
    def hashed(x):
        return x.withColumns({"h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(1), "value")})
    long = hashed(stacked_values(df, cols))
    counts = long.groupBy("column", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    # how many values are how frequent: at most one row for each frequency there is
    freq = counts.groupBy("column", "n").agg(F.count(F.lit(1)).alias("values"))
    per = freq.groupBy("column").agg(F.sum("values").alias("unique"), F.max("n").alias("top_count"),
                                     F.max_by("values", "n").alias("ties")).collect()
    spark = df.sparkSession
    if not per:
        return spark.createDataFrame([], "column string, unique long, top string, top_count long")
    even = [r["column"] for r in per if r["ties"] == r["unique"]]
    rest = [r for r in per if r["ties"] < r["unique"]]
    tops = {}
    if even:
        row = df.agg(*[F.min(qcol(c).cast("string")).alias(f"m{i}") for i, c in enumerate(even)]).first()
        tops |= {c: row[f"m{i}"] for i, c in enumerate(even)}
    if rest:
        best = spark.createDataFrame([(r["column"], r["top_count"]) for r in rest], "column string, n long")
        won = counts.join(F.broadcast(best), ["column", "n"]).select("column", "h1", "h2")  # one row per column to compare with
        won = F.broadcast(won) if sum(r["ties"] for r in rest) <= TIES else won
        texts = hashed(stacked_values(df, [r["column"] for r in rest])).join(won, ["column", "h1", "h2"], "left_semi")
        tops |= {r["column"]: r["top"] for r in texts.groupBy("column").agg(F.min("value").alias("top")).collect()}
    return spark.createDataFrame([(r["column"], r["unique"], tops[r["column"]], r["top_count"]) for r in per],
                                 "column string, unique long, top string, top_count long")


def value_counts(x, column: str) -> DataFrame:
    """Count per value, missing skipped; declared but unseen categories
    give 0 (full join to the category list)."""
    t = Table.of(x)
    df = t.df
    counts = (df.where(qcol(column).isNotNull())
              .groupBy(qcol(column).cast("string").alias("value"))
              .agg(F.count(F.lit(1)).alias("count")))
    cats = category_source(field_of(df, column)) if ltypes(df)[column] in CATEGORICAL else None
    if cats is None:
        return counts
    spark = df.sparkSession
    catdf = (open_table(spark, cats).select(F.col("v").alias("value")) if isinstance(cats, dict)
             else spark.createDataFrame([(str(v),) for v in cats], "value string"))
    # values outside the declared list (a model fitted on other rows lets them through) are counted too
    return (catdf.join(counts, "value", "full")
            .select("value", F.coalesce(qcol("count"), F.lit(0)).cast("long").alias("count")))


def missing_counts(x, columns=None) -> DataFrame:
    """(column, missing) for every column, from one aggregate."""
    t = Table.of(x)
    cols = list(columns) if columns is not None else t.columns
    agg = t.df.agg(*[(F.count(F.lit(1)) - F.count(qcol(c))).alias(f"m{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), qcol(f"m{i}").cast("long").alias("missing"))
                    for i, c in enumerate(cols)])
    return agg.select(F.inline(arr))


def _hist_edges(mn, mx, bins):
    """Bucket edges as pandas.cut builds them for an integer bin count."""
    if abs(mn) == float("inf") or abs(mx) == float("inf"):
        raise SchemaError("histogram: the column holds infinities, equal-width buckets have no edges")
    if mn == mx:
        adj = 0.001 * abs(mn) if mn != 0 else 0.001
        mn, mx = mn - adj, mx + adj
        step = (mx - mn) / bins
        edges = [i * step + mn for i in range(bins)] + [mx]
    else:
        step = (mx - mn) / bins
        edges = [i * step + mn for i in range(bins)] + [mx]
        edges[0] = edges[0] - (mx - mn) * 0.001
    return edges


def histogram(x, column: str, bins: int = 20) -> DataFrame:
    """A4/A5: ``bins`` equal-width buckets, right-closed, the first includes the
    minimum; empty buckets kept; missing skipped. Rows (bucket, left, right,
    count); datetime columns get timestamp edges."""
    if int(bins) < 2:
        raise SchemaError("at least 2 bins")
    t = Table.of(x)
    df = t.df
    lt = ltypes(df)[column]
    if lt == LType.DATETIME:
        v = epoch_micros(qcol(column), field_of(df, column).dataType).cast("double")
    elif lt == LType.NUMERIC:
        v = qcol(column).cast("double")
    else:
        raise SchemaError("histogram needs a Numeric or Datetime column")
    r = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx")).collect()[0]
    spark = df.sparkSession
    if r["mn"] is None:
        return _hist_frame(spark.range(0), lt)
    edges = _hist_edges(r["mn"], r["mx"], int(bins))
    b = count_below(v, edges[1:-1], strict=True)
    counts = df.where(v.isNotNull()).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    e = F.array(*[F.lit(float(x)) for x in edges])
    full = (spark.range(int(bins)).select(qcol("id").cast("int").alias("bucket"))
            .join(counts, "bucket", "left")
            .select("bucket", F.element_at(e, qcol("bucket") + 1).alias("left"),
                    F.element_at(e, qcol("bucket") + 2).alias("right"),
                    F.coalesce(qcol("count"), F.lit(0)).cast("long").alias("count")))
    return _hist_frame(full, lt)


def histograms(x, columns=None, bins: int = 20) -> DataFrame:
    """A4 for many numeric columns in two jobs: one aggregate for every
    column's range, one stacked ``groupBy(column, bucket)`` count (map-side
    combined) right-joined to the bucket list. Rows (column, bucket, left,
    right, count), as :func:`histogram` per column."""
    if int(bins) < 2:
        raise SchemaError("at least 2 bins")
    t = Table.of(x)
    df = t.df
    lt = ltypes(df)
    cols = [c for c in (columns or t.columns) if lt[c] == LType.NUMERIC]
    spark = df.sparkSession
    if not cols:
        raise SchemaError("histograms need Numeric columns")
    r = df.agg(*[F.min(qcol(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
               *[F.max(qcol(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]).collect()[0]
    edges = {c: _hist_edges(r[f"a{i}"], r[f"b{i}"], int(bins)) for i, c in enumerate(cols) if r[f"a{i}"] is not None}
    live = [c for c in cols if c in edges]
    structs = [F.struct(F.lit(c).alias("column"),
                        F.when(qcol(c).isNotNull(), count_below(qcol(c).cast("double"), edges[c][1:-1], strict=True))
                        .alias("bucket")) for c in live]
    counts = (df.select(F.inline(F.array(*structs))).where(qcol("bucket").isNotNull())
              .groupBy("column", "bucket").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.createDataFrame([(c, j, float(edges[c][j]), float(edges[c][j + 1]))
                                  for c in live for j in range(int(bins))],
                                 "column string, bucket int, left double, right double")  # columns x bins rows
    return (grid.join(counts, ["column", "bucket"], "left")
            .select("column", "bucket", "left", "right", F.coalesce(qcol("count"), F.lit(0)).cast("long").alias("count")))


def _hist_frame(df, lt):
    if "bucket" not in df.columns:
        df = df.select(F.lit(0).alias("bucket"), F.lit(0.0).alias("left"), F.lit(0.0).alias("right"),
                       F.lit(0).cast("long").alias("count")).limit(0)
    if lt == LType.DATETIME:
        return df.select("bucket",
                         from_epoch_micros(F.floor("left")).alias("left"),
                         from_epoch_micros(F.floor("right")).alias("right"),
                         "count")
    return df


def distinct_index_values(x, level: str | None = None) -> DataFrame:
    """A10: the distinct values of an index level (or column)."""
    t = Table.of(x)
    name = level or t.index[0]
    c = t.icol(name) if name in t.index else qcol(name)
    return t.df.select(c.alias(name)).distinct()
