"""Missing-value filters: F1-F6.

NULL is the only missing value (NaN becomes NULL where a table enters, see
``Table.of``). Index levels are never counted.
"""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ltypes import field_of
from ..names import qcol
from ..step import Step, register
from ..table import Table


def _share_or_number(opts):
    share, number = opts.get("percentage"), opts.get("number")
    if (share is None) == (number is None):
        yield ("not_given", "give exactly one of percentage or number")
    if share is not None and not (0.0 <= float(share) <= 1.0):
        yield ("percentage", "percentage must be within [0, 1]")
    if number is not None and int(number) < 0:
        yield ("number", "number must be >= 0")


def null_count_expr(cols):
    return reduce(add, [qcol(c).isNull().cast("int") for c in cols], F.lit(0))


#: Cells a row may have before a filter on their number is kept out of one generated method.
FUSED_CELLS = 32


def _few_nulls(t, few):
    """The condition ``few`` on the number of missing cells of a row.

    For a wide table one generated method over all cells (with the expressions that
    make them) grows past what the JVM compiles, and runs interpreted. A condition
    with a lambda is generated in small methods instead, so a part of ``few`` is
    added as one: a single cell must not be too many already.
    """
    cols = t.columns
    cond = few(null_count_expr(cols))
    may_miss = [c for c in cols if field_of(t.df, c).nullable]
    if len(cols) <= FUSED_CELLS or not may_miss:
        return cond
    return cond & F.forall(F.array(null_count_expr(may_miss[:1])), few)


@register
class RemoveNanRows(Step):
    """keep rows with at most ``number`` missing cells, or with a missing
    share ``<= percentage`` (a share of 0.0 is a valid option)."""
    key = "remove_nan_rows"

    def check(self):
        yield from _share_or_number(self.options)

    def _transform(self, t, params):
        cols = t.columns
        if self.options.get("number") is not None:
            few = lambda nulls: nulls <= F.lit(int(self.options["number"]))
        else:
            # the share as a quotient: 29 of 100 is exactly 0.29, 0.29 * 100 is not 29
            few = lambda nulls: nulls / F.lit(float(max(1, len(cols)))) <= F.lit(float(self.options["percentage"]))
        return t.with_df(t.df.where(_few_nulls(t, few)))


@register
class RemoveNanColumns(Step):
    """drop columns with more than ``number`` missing values, or a
    missing share above ``percentage``. Fit = one aggregate over all columns."""
    key = "remove_nan_columns"
    streaming = "fit"

    def check(self):
        yield from _share_or_number(self.options)

    def _fit(self, t):
        cols = t.columns
        row = t.df.agg(F.count(F.lit(1)).alias("__n"),
                       *[F.count(qcol(c)).alias(f"c{i}") for i, c in enumerate(cols)]).collect()[0]
        n = row["__n"]
        nulls = {c: n - row[f"c{i}"] for i, c in enumerate(cols)}
        if self.options.get("number") is not None:
            drop = [c for c in cols if nulls[c] > int(self.options["number"])]
        else:
            share = float(self.options["percentage"])
            drop = [c for c in cols if n and nulls[c] / n > share]
        return {"rows": n, "missing": nulls, "dropped": drop}

    def _transform(self, t, params):
        return t.with_df(t.df.drop(*params["dropped"]))


@register
class KeepIndexValues(Step):
    """keep rows whose (single-level) index, or a given column, takes one of
    ``values``. A DataFrame of values is applied as a semi join (no collect)."""
    key = "keep_index_values"

    def check(self):
        if self.options.get("values") is None:
            yield ("not_given", "no values given")

    def _transform(self, t, params):
        column = self.options.get("column")
        key = qcol(column) if column else t.icol(t.index[0])
        return t.with_df(t.df.where(key.isin(list(self.options["values"]))))


def keep_values_in(x, key: str, values: DataFrame, value_col: str | None = None):
    """F5 with a long list held in a DataFrame: ``left_semi`` join, Spark picks
    broadcast only when its size estimate allows."""
    t = Table.of(x)
    vc = value_col or values.columns[0]
    kcol = t.icol(key) if key in t.index else qcol(key)
    out = t.df.join(values.select(qcol(vc).alias("__v")).distinct(), kcol.eqNullSafe(qcol("__v")),
                    "left_semi")
    return out if isinstance(x, DataFrame) else t.with_df(out)


@register
class DropMissing(Step):
    """drop rows with a missing value in ``subset`` (all columns when unset)."""
    key = "drop_missing"

    def _transform(self, t, params):
        subset = self.options.get("subset") or t.columns
        present = reduce(and_, [qcol(c).isNotNull() for c in subset], F.lit(True))
        return t.with_df(t.df.where(present))
