"""Projection and schema operators: P1-P3, P5-P7, P11, P12.

All are row-local single ``select``s; Catalyst prunes the scan to the columns
that survive.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..ltypes import LType, field_of, ltypes
from ..names import qcol, qcols
from ..step import Step, register
from ..table import Table, ix


@register
class DropColumns(Step):
    """Drop the selected columns."""
    key = "drop_columns"

    def check(self):
        if not self.options.get("columns"):
            yield ("not_given", "no column selected")

    def input_columns(self):
        return list(self.options["columns"])

    def _transform(self, t, params):
        return t.with_df(t.df.drop(*self.options["columns"]))


@register
class DuplicateColumns(Step):
    """Append copies ``{column: new_name}`` at the end, metadata kept."""
    key = "duplicate_columns"

    def check(self):
        table = self.options.get("table") or {}
        if not table:
            yield ("not_given", "no column selected")
        names = list(table.values())
        if any(not n for n in names):
            yield ("empty_name", "new names must not be empty")
        if len(set(names)) != len(names):
            yield ("unique", "new names must be distinct")

    def input_columns(self):
        return list(self.options["table"])

    def _transform(self, t, params):
        table = self.options["table"]
        clash = set(table.values()) & set(t.columns)
        if clash:
            raise SchemaError(f"duplicate_columns: names already present {sorted(clash)}")
        extra = [qcol(c).alias(n, metadata=field_of(t.df, c).metadata) for c, n in table.items()]
        return t.with_df(t.df.select("*", *extra))


@register
class RenameColumns(Step):
    """Rename with ``{old: new}``; all names set at once, so swaps work."""
    key = "rename_columns"

    def check(self):
        names = self.options.get("names") or {}
        if not names:
            yield ("not_given", "no rename given")
        if any(not n for n in names.values()):
            yield ("empty_name", "new names must not be empty")

    def input_columns(self):
        return list(self.options["names"])

    def _transform(self, t, params):
        names = self.options["names"]
        new = [names.get(c, c) if c in t.columns else c for c in t.df.columns]
        data_new = [n for n, c in zip(new, t.df.columns) if c in t.columns]
        if len(set(data_new)) != len(data_new):
            raise SchemaError("rename_columns: resulting names are not unique")
        return t.with_df(t.df.toDF(*new))


def rename_all(x, new_names: list[str]):
    """P3 by full list of names; wrong length is an error."""
    t = Table.of(x)
    if len(new_names) != len(t.columns):
        raise SchemaError(f"expected {len(t.columns)} names, got {len(new_names)}")
    return RenameColumns(names=dict(zip(t.columns, new_names)))(x)


@register
class SelectColumns(Step):
    """P5: keep columns whose name matches ``regex`` (case-insensitive) and/or
    whose logical type is in ``types``."""
    key = "select_columns"

    def check(self):
        if self.options.get("regex") is None and not self.options.get("types"):
            yield ("not_given", "give regex and/or types")
        if self.options.get("regex") is not None:
            try:
                re.compile(self.options["regex"])
            except re.error as e:
                yield ("regex", str(e))

    def _transform(self, t, params):
        rx = self.options.get("regex")
        types = {LType(v) for v in self.options.get("types") or []}
        lt = ltypes(t.df)
        keep = [c for c in t.columns
                if (rx is None or re.search(rx, c, re.IGNORECASE))
                and (not types or lt[c] in types)]
        return t.with_df(t.df.select(*qcols(t.index_columns), *qcols(keep)))


@register
class SetIndex(Step):
    """The selected columns become the index, replacing (dropping) the old one."""
    key = "set_index"

    def check(self):
        if not self.options.get("columns"):
            yield ("not_given", "no column selected")

    def input_columns(self):
        return list(self.options["columns"])

    def _transform(self, t, params):
        cols = list(self.options["columns"])
        df = t.df.drop(*t.index_columns)
        rest = [c for c in t.columns if c not in cols]
        df = df.select(*[qcol(c).alias(ix(c), metadata=field_of(df, c).metadata) for c in cols],
                       *qcols(rest))
        return Table(df, tuple(cols))


@register
class ResetIndex(Step):
    """Index levels come back as leading columns; a clash gets ``_index``."""
    key = "reset_index"

    def _transform(self, t, params):
        return Table(t.to_df(), ())


@register
class IntsToFloats(Step):
    """Every integer column to double."""
    key = "ints_to_floats"

    def _transform(self, t, params):
        ints = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        exprs = [qcol(f.name).cast("double").alias(f.name, metadata=f.metadata)
                 if isinstance(f.dataType, ints) and not f.name.startswith("__ix__")
                 else qcol(f.name) for f in t.df.schema.fields]
        return t.with_df(t.df.select(*exprs))


def table_info(x) -> DataFrame:
    """One row (rows, columns, index_levels, index_names) from one count job."""
    t = Table.of(x)
    return (t.df.agg(F.count(F.lit(1)).alias("rows"))
            .select("rows",
                    F.lit(len(t.columns)).alias("columns"),
                    F.lit(len(t.index)).alias("index_levels"),
                    F.lit(",".join(t.index)).alias("index_names")))


def select_by(x, regex=None, types=None):
    return SelectColumns(regex=regex, types=[LType(v).value for v in (types or [])])(x)


__all__ = ["DropColumns", "DuplicateColumns", "RenameColumns", "SelectColumns", "SetIndex",
           "ResetIndex", "IntsToFloats", "table_info", "rename_all", "select_by", "Table"]
