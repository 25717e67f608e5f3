"""Table comparison: U2 (equality), U3 (cell diff), U4 (drop duplicate columns)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions.pyformat import py_float_str
from ..ltypes import LType, STRINGLIKE, field_of, ltype_of_field, ltypes
from ..names import qcol, qcols
from ..step import Step, register
from .join import skew_join
from ..table import Table


def row_digest(cols, seed: int):
    """64-bit hash of the values of a row; a missing value counts by its place (Spark's hash alone skips it)."""
    return F.xxhash64(F.lit(seed), *[x for c in cols for x in (c, c.isNull())])


def _balance(a, b, cols, by=None):
    """Sums of row digests and row counts of ``a`` less those of ``b``, over all rows or by a column made from them.

    Two independent 64-bit hashes of every row are added up (in 128 bits), so tables with equal sums have equal rows but
    for a chance of about 2**-128. Rows stay where they are: a task sends one row for each value of ``by``.
    """
    def side(df, sign):
        values = [qcol(c) for c in cols]
        keys = [] if by is None else [by(df).alias("__at")]
        return df.select(*keys, *[(F.lit(sign) * row_digest(values, k).cast("decimal(20,0)")).alias(f"__h{k}") for k in (1, 2)], F.lit(sign).alias("__n"))
    both = side(a, 1).unionByName(side(b, -1))
    grouped = both if by is None else both.groupBy("__at")
    out = grouped.agg(*[F.sum(f"__h{k}").alias(f"__h{k}") for k in (1, 2)], F.sum("__n").alias("__n"))
    return out.withColumn("__same", F.coalesce((F.col("__h1") == 0) & (F.col("__h2") == 0) & (F.col("__n") == 0), F.lit(True)))


def table_equal(a, b) -> DataFrame:
    """One row ``equal``: same columns with the same logical types, and the
    same multiset of rows (order ignored). One aggregate over both tables adds up
    digests of the rows (see ``_balance``); no row is moved."""
    ta, tb = Table.of(a), Table.of(b)
    sa, sb = ltypes(ta.df), ltypes(tb.df)
    if sa != sb:
        return ta.df.sparkSession.range(1).select(F.lit(False).alias("equal"))
    x, y = _alike(ta.df, tb.df, sorted(sa))
    return _balance(x, y, sorted(sa)).select(F.col("__same").alias("equal"))


def _alike(a: DataFrame, b: DataFrame, cols) -> tuple[DataFrame, DataFrame]:
    """Both tables with each column in the type that a union of them would have, so that equal values hash alike."""
    kinds = a.select(*qcols(cols)).limit(0).unionByName(b.select(*qcols(cols)).limit(0)).schema
    cast = lambda df: df.select(*[qcol(f.name).cast(f.dataType).alias(f.name) for f in kinds.fields])
    return cast(a), cast(b)


#: Ranges of the key's hash whose digests are compared first, and how finely those that differ are cut up next.
RANGES, FINE = 1_024, 1 << 20


def _differing(L: DataFrame, R: DataFrame, keys, cols):
    """A condition, for either side, that every row of a key with a difference meets, and few others; None if no row does.

    A digest tree of two levels over the hash of the key: ranges whose sums agree hold no difference and their rows are
    not moved. At most FINE numbers are broadcast.
    """
    x, y = _alike(L, R, [*keys, *cols])
    key_hash = lambda df: row_digest([qcol(k) for k in keys], 3)
    coarse = lambda df: F.pmod(key_hash(df), F.lit(RANGES)).cast("int")
    wrong = [r["__at"] for r in _balance(x, y, [*keys, *cols], coarse).where("not __same").select("__at").collect()]
    if not wrong:
        return None
    x, y = (df.where(coarse(df).isin(wrong)) for df in (x, y))
    fine = lambda df: F.pmod(key_hash(df), F.lit(FINE)).cast("int")
    finer = _balance(x, y, [*keys, *cols], fine).where("not __same").select("__at")
    kinds = {f.name: f.dataType for f in x.schema.fields}

    def keep(df):
        own = df.withColumn("__at_key", F.pmod(row_digest([qcol(k).cast(kinds[k]) for k in keys], 3), F.lit(FINE)).cast("int"))
        return own.join(F.broadcast(finer), F.col("__at_key") == F.col("__at"), "left_semi").drop("__at_key")
    return keep


def table_diff(a, b, key: str | list[str], options: dict | None = None) -> DataFrame:
    """Cells of ``a`` that differ from ``b``, matched on ``key``, long form
    ``(key..., column, left, right)``; a row missing on one side differs in
    every column; a column on one side only is an error. Where a key has one row a
    side, only rows near a difference are moved (see ``_differing``): full outer join
    on the key (null-safe; ``options`` passes the settings of :func:`join.skew_join`).
    A repeated key pairs each of its rows with each of the other side, so with
    repeated keys all rows are joined."""
    ta, tb = Table.of(a), Table.of(b)
    keys = [key] if isinstance(key, str) else list(key)
    lone = sorted(set(ta.columns) ^ set(tb.columns))
    if lone:
        raise SchemaError(f"table_diff: columns on one side only: {lone}")
    cols = [c for c in ta.columns if c not in keys]
    da, db = ta.df, tb.df
    if not _repeats(da, keys) and not _repeats(db, keys):
        keep = _differing(da, db, keys, cols)
        da, db = (da.limit(0), db.limit(0)) if keep is None else (keep(da), keep(db))
    L = da.select(*[qcol(k).alias("l__" + k) for k in keys], *[qcol(c).alias("l_" + c) for c in cols],
                  F.lit(True).alias("__in_l"))
    R = db.select(*[qcol(k).alias("r__" + k) for k in keys], *[qcol(c).alias("r_" + c) for c in cols],
                  F.lit(True).alias("__in_r"))
    j = skew_join(L, R, ["l__" + k for k in keys], ["r__" + k for k in keys], "full", options or {})
    alone = qcol("__in_l").isNull() | qcol("__in_r").isNull()
    cells = F.array(*[F.struct(F.lit(c).alias("column"),
                               _text(ta.df, "l_" + c, c).alias("left"),
                               _text(tb.df, "r_" + c, c).alias("right"),
                               (alone | ~qcol("l_" + c).eqNullSafe(qcol("r_" + c))).alias("d"))
                      for c in cols])
    keyed = j.select(*[F.when(qcol("__in_l").isNotNull(), qcol("l__" + k)).otherwise(qcol("r__" + k)).alias(k) for k in keys],
                     F.filter(cells, lambda s: s["d"]).alias("__cells"))
    return keyed.select(*qcols(keys), F.inline("__cells")).drop("d")


def _repeats(df: DataFrame, keys) -> bool:
    """Whether any key has two rows: only 128-bit digests of the keys are moved."""
    values = [qcol(k) for k in keys]
    digests = df.select(row_digest(values, 4).alias("a"), row_digest(values, 5).alias("b"))
    return not digests.groupBy("a", "b").count().where("count > 1").isEmpty()


def _text(df, name, orig):
    f = field_of(df, orig)
    if ltype_of_field(f) == LType.NUMERIC and f.dataType.typeName() in ("double", "float"):
        return py_float_str(qcol(name))
    return qcol(name).cast("string")


def _canon(c, lt):
    if lt == LType.NUMERIC:
        return qcol(c).cast("double")
    if lt in STRINGLIKE:
        return qcol(c).cast("string")
    return qcol(c)


@register
class RemoveDuplicateColumns(Step):
    """U4: among ``attributes``, drop every column equal cell-by-cell to an
    earlier one of the same kind (Nominal/Ordinal/String compared as text;
    missing equals missing). Fit: an order-free fingerprint per column (exact
    decimal sum of 64-bit hashes), then ``bool_and(a <=> b)`` of each column
    with the first column of its fingerprint."""
    key = "remove_duplicate_columns"
    streaming = "fit"

    def check(self):
        if not self.options.get("attributes"):
            yield ("no_columns", "no column selected")

    def input_columns(self):
        return list(self.options["attributes"])

    def _fit(self, t):
        sel = set(self.options["attributes"])
        lt = ltypes(t.df)
        cols = [c for c in t.columns if c in sel]
        kind = {c: ("text" if lt[c] in STRINGLIKE else lt[c].value) for c in cols}
        fp = t.df.agg(*[F.sum(F.xxhash64(_canon(c, lt[c])).cast("decimal(38,0)")).alias(f"h{i}")
                        for i, c in enumerate(cols)]).collect()[0]
        # one representative per class of equal columns: columns of one fingerprint are
        # compared with the representatives so far, one job per further class (usually one)
        classes: dict = {}
        for i, c in enumerate(cols):
            classes.setdefault((kind[c], fp[f"h{i}"]), []).append(c)
        drop, todo = [], [v for v in classes.values() if len(v) > 1]
        while todo:
            pairs = [(v[0], c) for v in todo for c in v[1:]]
            row = t.df.agg(*[F.bool_and(_canon(a, lt[a]).eqNullSafe(_canon(b, lt[b]))).alias(f"p{i}")
                             for i, (a, b) in enumerate(pairs)]).collect()[0]
            same = {b for i, (_, b) in enumerate(pairs) if row[f"p{i}"] is not False}
            drop += sorted(same, key=cols.index)
            todo = [rest for v in todo if len(rest := [c for c in v[1:] if c not in same]) > 1]
        return {"dropped": sorted(drop, key=cols.index)}

    def _transform(self, t, params):
        return t.with_df(t.df.drop(*params["dropped"]))


__all__ = ["table_equal", "table_diff", "RemoveDuplicateColumns"]
