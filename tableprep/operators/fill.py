"""Filling missing values: N1 (value), N2 (mean), W1 (forward), W2 (backward).

Forward/backward fill need a row order, which Spark rows do not have: the
caller names ``order_by`` (unique within a group) and optionally
``partition_by``. A plain window would pull a whole group -- or, without
``partition_by``, the whole table -- into one task, so the fill runs over
ranges of the order key (range-carry scheme):

1. ``percentile_approx`` cuts the order key into R ranges (one small job);
   R grows with the table (about 2,000,000 rows per range), never fewer than
   the shuffle partitions;
2. rows are tagged with their range id (binary search; rows without an order key are a first range of their own) and
   range-partitioned on (group, range);
3. per (group, range) the last (first) non-missing value of every column is
   aggregated -- at most groups x R rows; without groups, for text columns,
   only its position is aggregated (a hash aggregate; max_by over text would
   sort every row) and the values at the carry positions are joined back;
4. the carry from earlier (later) ranges is a window over that summary,
   partitioned by group (at most R rows per group);
5. the window inside (group, range) fills what it can, the carry the rest.

Backward fills run the same growing frames over the order reversed: a frame that
ends at the last row is evaluated anew for every row, which is quadratic in a range.

A hot group is split over R ranges instead of landing in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions import summaries
from ..functions.buckets import with_count_below
from ..functions.timeutil import epoch_micros, from_epoch_micros
from ..ltypes import LType, field_of, ltypes
from ..names import qcol, qcols
from ..session import shuffle_partitions
from ..step import Step, register

METHODS = ("value", "mean", "ffill", "bfill")
_FIXED = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
          T.DateType, T.TimestampType, T.TimestampNTZType)


def _ts_micros(c, dtype=None):
    return epoch_micros(c, dtype)


def _order_number(df, name):
    dt = field_of(df, name).dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return _ts_micros(qcol(name), dt)
    if isinstance(dt, T.StringType):
        raise SchemaError("fill: order_by must be numeric or datetime")
    return qcol(name)


ROWS_PER_RANGE = 2_000_000
GRID = 1024


def range_edges(df, okey, ranges=None, min_ranges=2, rows_per_range=ROWS_PER_RANGE):
    """Sorted cut points of the order key into R ranges of about equal size.

    R grows with the data: max(``min_ranges``, rows / ``rows_per_range``), so one range -- one window group -- stays bounded whatever the
    table size. One job gives the row count and a 1,024-point quantile grid;
    only when more ranges than that are needed a finer grid is computed."""
    if ranges:
        probs = [i / int(ranges) for i in range(1, int(ranges))]
        e = df.agg(F.percentile_approx(okey, probs, max(10_000, 4 * int(ranges))).alias("e")).collect()[0]["e"]
        return sorted(set(x for x in (e or []) if x is not None))
    grid = [i / GRID for i in range(1, GRID)]
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 F.percentile_approx(okey, grid, 4 * GRID * 4).alias("e")).collect()[0]
    n = row["n"]
    want = max(int(min_ranges), -(-n // int(rows_per_range)))
    if want <= GRID:
        g = row["e"] or []
        picks = [g[round(j * GRID / want) - 1] for j in range(1, want)] if g else []
        return sorted(set(x for x in picks if x is not None))
    R = want
    probs = [i / R for i in range(1, R)]
    e = df.agg(F.percentile_approx(okey, probs, 4 * R).alias("e")).collect()[0]["e"]
    return sorted(set(x for x in (e or []) if x is not None))


def _so_far(cols, part, forward, end):
    """The last non-missing value from the first row (backward: the last) up to ``end`` rows from this one, as a function of a column."""
    order = [qcol(c) if forward else qcol(c).desc() for c in cols]
    w = Window.partitionBy(*qcols(part)).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    return lambda c: F.last(c, ignorenulls=True).over(w)


def directional_fill(df, cols, order_by: str, partition_by=(), forward=True, ranges=None,
                     rows_per_range=ROWS_PER_RANGE):
    """Forward (``forward=True``) or backward fill of ``cols`` over the order of
    ``order_by`` within ``partition_by`` groups, by the range-carry scheme."""
    spark = df.sparkSession
    part = list(partition_by or [])
    okey = _order_number(df, order_by)
    edges = range_edges(df, okey, ranges, max(2, shuffle_partitions(spark)), rows_per_range)
    tagged = with_count_below(df.withColumn("__okey", okey), qcol("__okey"), edges, "__rid")
    # a missing order key sorts first: a range before all others, where any order is right
    zero = F.lit(0).cast(tagged.schema["__okey"].dataType)
    tagged = tagged.withColumns({"__rid": F.coalesce(qcol("__rid"), F.lit(-1)), "__okey": F.coalesce(qcol("__okey"), zero)})
    inner = ["__okey"]
    if not forward:  # rows that tie in the order key stay in the order they came in when the order is reversed
        tagged, inner = tagged.withColumn("__at", F.monotonically_increasing_id()), ["__okey", "__at"]
    keys = part + ["__rid"]
    if part and not _hot_group(df, part, rows_per_range, ranges):
        # no group outgrows a range: one window per group, no carry needed
        win = _so_far(["__rid", *inner], part, forward, 0)
        return tagged.select(*[F.coalesce(qcol(f.name), win(qcol(f.name))).alias(f.name, metadata=f.metadata)
                               if f.name in cols else qcol(f.name) for f in df.schema.fields])

    # max_by over fixed-width values stays a hash aggregate; over text it would
    # sort every row, so text columns carry positions and fetch their values last
    fixed = all(isinstance(df.schema[c].dataType, _FIXED) for c in cols)
    if fixed:
        pick = F.max_by if forward else F.min_by
        summary = tagged.groupBy(*qcols(keys)).agg(
            *[pick(qcol(c), F.when(qcol(c).isNotNull(), qcol("__okey"))).alias(c) for c in cols])
        carry_fn = _so_far(["__rid"], part, forward, -1)
        carry = summary.select(*qcols(keys), *[carry_fn(qcol(c)).alias(f"__carry_{i}") for i, c in enumerate(cols)])
    else:
        carry = _carry_by_position(tagged, cols, part, forward)  # texts of any size: the planner picks the join

    # at least one partition per range when ranges outnumber shuffle partitions
    n_parts = max(shuffle_partitions(spark), len(edges) + 1)
    data = tagged.repartitionByRange(n_parts, *qcols(keys)) if not part else tagged.repartition(n_parts, *qcols(keys))
    # groups may be missing (NULL) too: a null-safe join on renamed keys
    carry = carry.select(*[qcol(k).alias(f"__c{i}") for i, k in enumerate(keys)],
                         *[qcol(f"__carry_{i}") for i in range(len(cols))])
    if not part and fixed:
        carry = F.broadcast(carry)  # at most R rows of fixed width
    match = reduce(and_, [qcol(k).eqNullSafe(qcol(f"__c{i}")) for i, k in enumerate(keys)])
    joined = data.join(carry, match, "left")
    win = _so_far(inner, keys, forward, 0)
    idx = {c: i for i, c in enumerate(cols)}
    out = []
    for f in df.schema.fields:
        if f.name in idx:
            e = F.coalesce(qcol(f.name), win(qcol(f.name)), qcol(f"__carry_{idx[f.name]}"))
            out.append(e.alias(f.name, metadata=f.metadata))
        else:
            out.append(qcol(f.name))
    return joined.select(*out)


def _hot_group(df, part, rows_per_range, ranges) -> bool:
    """Whether some group holds more rows than a range should (or ranges were asked for)."""
    if ranges:
        return True
    sizes = df.groupBy(*qcols(part)).agg(F.count(F.lit(1)).alias("__n"))
    return (sizes.agg(F.max("__n")).first()[0] or 0) > rows_per_range


def _carry_by_position(tagged, cols, part, forward):
    """Carry table (group..., __rid, __carry_i...) of a fill over text, as one lazy
    plan: per group and range the position of the last (first) non-missing value
    of each column (a hash aggregate over numbers, at most groups x R rows), the
    carry positions from earlier (later) ranges by a window over those rows, the
    values at those positions by a join on (group, range, position). Only the
    rows at carry positions send their texts."""
    agg, keys = (F.max if forward else F.min), [*part, "__rid"]
    pos = tagged.groupBy(*qcols(keys)).agg(
        *[agg(F.when(qcol(c).isNotNull(), qcol("__okey"))).alias(f"__p{i}") for i, c in enumerate(cols)])
    pick = _so_far(["__rid"], part, forward, -1)
    at = [F.when(qcol(f"__p{i}").isNotNull(), F.struct(qcol("__rid").alias("r"), qcol(f"__p{i}").alias("p"))) for i in range(len(cols))]
    carry_pos = pos.select(*qcols(keys), *[pick(x).alias(f"__cp{i}") for i, x in enumerate(at)])
    own = [f"__g{i}" for i in range(len(part))]
    need = (carry_pos.select(*[qcol(k).alias(o) for k, o in zip(part, own)], qcol("__rid").alias("__to"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("__ci"), qcol(f"__cp{i}").alias("__cp")) for i in range(len(cols))])))
        .where(qcol("__cp").isNotNull()).select(*own, "__to", "__ci", F.col("__cp.r").alias("__from"), F.col("__cp.p").alias("__pos")))
    if not part:
        need = F.broadcast(need)  # at most R x columns positions of fixed width
    match = reduce(and_, [qcol(k).eqNullSafe(qcol(o)) for k, o in zip(part, own)],
                   (qcol("__rid") == qcol("__from")) & (qcol("__okey") == qcol("__pos")))
    vals = tagged.select(*qcols(keys), "__okey", *qcols(cols)).join(need, match)
    # one row a column; rows that tie in the order key are as good as each other (collect_list stays a hash aggregate)
    return vals.groupBy(*[qcol(o).alias(k) for k, o in zip(part, own)], qcol("__to").alias("__rid")).agg(
        *[F.get(F.sort_array(F.collect_list(F.when(qcol("__ci") == i, qcol(c))), False), F.lit(0)).alias(f"__carry_{i}") for i, c in enumerate(cols)])


@register
class FillNan(Step):
    """N1/N2/W1/W2. ``selected``: list of columns, or ``{column: fill value}``
    for ``method='value'`` (Numeric and Datetime only, timestamps as
    ``%Y-%m-%d %H:%M:%S``)."""
    key = "fill_nan"

    def check(self):
        m = self.options.get("method")
        if m not in METHODS:
            yield ("method", f"method must be one of {METHODS}")
        if not self.options.get("selected"):
            yield ("not_given", "no column selected")
        if m == "value" and not isinstance(self.options.get("selected"), dict):
            yield ("value", "method 'value' needs {column: value}")
        if m in ("ffill", "bfill") and not self.options.get("order_by"):
            yield ("order", "ffill/bfill need order_by (Spark rows have no order)")

    @property
    def streaming(self):  # type: ignore[override]
        m = self.options.get("method")
        return {"value": "yes", "mean": "fit"}.get(m, "no")

    @property
    def accepts(self):  # type: ignore[override]
        if self.options.get("method") in ("value", "mean"):
            return frozenset({LType.NUMERIC, LType.DATETIME})
        return frozenset(LType) - {LType.OTHER}

    def input_columns(self):
        return list(self.options["selected"])

    def needs_fit(self):
        return self.options.get("method") == "mean"

    def _fit(self, t):
        if self.options["method"] != "mean":
            return {}
        cols = list(self.options["selected"])
        lt = ltypes(t.df)
        aggs = []
        for i, c in enumerate(cols):
            if lt[c] == LType.DATETIME:
                # exact: decimal sum of microseconds, floored mean
                aggs.append(F.floor(F.sum(_ts_micros(qcol(c), field_of(t.df, c).dataType).cast("decimal(38,0)"))
                                    / F.count(qcol(c))).cast("long").alias(f"m{i}"))
            else:
                aggs.append(F.avg(qcol(c).cast("double")).alias(f"m{i}"))
        row = t.df.agg(*aggs).collect()[0]
        return {"means": {c: row[f"m{i}"] for i, c in enumerate(cols)}}

    def summary_columns(self, types):
        cols = list(self.options["selected"])
        return cols if self.options["method"] == "mean" and all(types.get(c) == LType.NUMERIC for c in cols) else None

    def fit_from(self, summary):
        return {"means": {c: summary[c]["mean"] for c in self.options["selected"]}}

    def summary_after(self, summary, params):
        return {c: summaries.filled(s, params["means"][c]) if c in params["means"] else s for c, s in summary.items()}

    def _transform(self, t, params):
        m = self.options["method"]
        df = t.df
        if m in ("ffill", "bfill"):
            cols = list(self.options["selected"])
            out = directional_fill(df, cols, self.options["order_by"],
                                   self.options.get("partition_by") or (),
                                   forward=(m == "ffill"), ranges=self.options.get("ranges"))
            return t.with_df(out)
        lt = ltypes(df)
        if m == "value":
            values = dict(self.options["selected"])
        else:
            values = params["means"]
        exprs = []
        for f in df.schema.fields:
            if f.name in values and values[f.name] is not None:
                v = values[f.name]
                if lt[f.name] == LType.DATETIME:
                    if m == "mean":
                        lit = from_epoch_micros(F.lit(int(v)))
                    else:
                        lit = F.to_timestamp_ntz(F.lit(str(v)), F.lit("yyyy-MM-dd HH:mm:ss"))
                    fill = lit.cast(f.dataType)
                else:
                    fill = F.lit(float(v)).cast(f.dataType) if not isinstance(
                        f.dataType, (T.DoubleType, T.FloatType)) else F.lit(float(v))
                    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                        # pandas turns the column to float when the fill is fractional
                        exprs.append(F.coalesce(qcol(f.name).cast("double"), F.lit(float(v)))
                                     .alias(f.name, metadata=f.metadata))
                        continue
                exprs.append(F.coalesce(qcol(f.name), fill).alias(f.name, metadata=f.metadata))
            else:
                exprs.append(qcol(f.name))
        return t.with_df(df.select(*exprs))
