"""O1/O2: sort rows (Ordinal columns by category position); U1: append tables.

A global ``orderBy`` range-partitions on the sort key, and all rows of one
value land in one range -- a value holding a third of the rows would make
one task hold a third of the table. Rows that tie on the requested keys
have no defined order, so a hash of the whole row is added as a last sort
key: the range partitioner can then cut through a hot value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..errors import OptionError
from ..functions.category_table import open_table, with_code
from ..functions.store import stored
from ..ltypes import LType, category_code, category_source, field_of, ltypes
from ..names import qcol
from ..step import Step, register
from ..table import Table


def sort_key(df, name, code=None):
    """What ``name`` is sorted by; ``code``: the column that holds its positions in a stored category table."""
    if code is not None:
        return qcol(code)
    if ltypes(df)[name] == LType.ORDINAL:
        cats = category_source(field_of(df, name))
        # without a list the categories are the sorted values themselves
        return qcol(name) if cats is None else category_code(qcol(name), cats)
    return qcol(name)


@register
class SortRows(Step):
    """``by``: columns (or index levels) in order; ``ascending`` (bool or list).
    Missing values last."""
    key = "sort_rows"
    streaming = "no"

    def check(self):
        if not self.options.get("by"):
            yield ("not_given", "no sort column")

    def _transform(self, t, params):
        asc = self.options.get("ascending", True)
        df, keys = sorted_by(t, self.options["by"], asc)
        return t.with_df(df.orderBy(*keys).select(*[qcol(c) for c in t.df.columns]))


def sorted_by(t: Table, by, ascending=True):
    """``t``'s rows with what they are sorted by, and the sort keys: missing values last, ties in the order of a hash
    of the whole row."""
    by = [by] if isinstance(by, str) else list(by)
    asc = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    df, keys = t.df, []
    for i, (name, a) in enumerate(zip(by, asc)):
        col, code = f"__ix__{name}" if name in t.index else name, None
        cats = category_source(field_of(t.df, col)) if ltypes(t.df)[col] == LType.ORDINAL else None
        if isinstance(cats, dict):
            code = f"__code{i}"
            df = with_code(df, col, open_table(df.sparkSession, cats), code)
        k = sort_key(df, col, code)
        keys.append(k.asc_nulls_last() if a else k.desc_nulls_last())
    return df, [*keys, F.xxhash64(*[qcol(c) for c in t.df.columns])]


def with_positions(x, by, ascending=True, name: str = "position"):
    """O1/O2: every row with its position (from 0) in the order of ``by``, as column ``name``.

    The sorted rows are stored once, range by range; a row's position is its
    place in its range plus the rows of the ranges before (one number each), so
    no window runs over the whole table.
    """
    t = Table.of(x)
    if name in t.columns:
        raise OptionError([("taken", f"there is a column {name}")])
    df, keys = sorted_by(t, by, ascending)
    rows = stored(df.orderBy(*keys).select(*[qcol(c) for c in t.df.columns], F.monotonically_increasing_id().alias(name)))
    part, row = F.shiftright(qcol(name), 33), qcol(name).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__before"))
    out = rows.withColumn("__p", part).join(F.broadcast(before), "__p")
    out = out.select(*[qcol(c) for c in t.df.columns], (F.col("__before") + row).alias(name))
    out = Table(out, t.index)
    return out if isinstance(x, Table) else out.to_df()


def append_tables(*xs):
    """Rows of all tables, columns matched by name, missing columns NULL."""
    ts = [Table.of(x) for x in xs]
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.df for t in ts])
    out = Table(df, ts[0].index)
    return out if isinstance(xs[0], Table) else out.to_df()
