"""Table = a DataFrame plus the names of its index levels.

Index levels are ordinary columns of the DataFrame stored under a reserved
prefix, so data columns may reuse an index name (as in the reference, where
the index is not a column) and column operators never see them. Spark rows
have no order, so there is no default range index: a table without index
simply has ``index == ()``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from .ltypes import canonicalize
from .names import qcol

IX = "__ix__"


def clean(df: DataFrame) -> DataFrame:
    """``df`` with NaN as NULL; frames that steps return are clean already."""
    if getattr(df, "_tableprep_clean", False):
        return df
    return marked_clean(canonicalize(df))


def marked_clean(df: DataFrame) -> DataFrame:
    df._tableprep_clean = True
    return df


def ix(name: str) -> str:
    return IX + name


@dataclass(frozen=True)
class Table:
    df: DataFrame
    index: tuple[str, ...] = ()

    @staticmethod
    def of(x) -> "Table":
        if isinstance(x, Table):
            return x if getattr(x.df, "_tableprep_clean", False) else Table(clean(x.df), x.index)
        if isinstance(x, DataFrame):
            return Table(clean(x), ())
        raise TypeError(f"expected DataFrame or Table, got {type(x).__name__}")

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(IX)]

    @property
    def index_columns(self) -> list[str]:
        return [ix(n) for n in self.index]

    def icol(self, name: str) -> Column:
        return qcol(ix(name))

    def with_df(self, df: DataFrame) -> "Table":
        return Table(df, self.index)

    @property
    def is_streaming(self) -> bool:
        return self.df.isStreaming

    def to_df(self) -> DataFrame:
        """Index levels come back as leading columns (``reset_index``)."""
        if not self.index:
            return self.df
        data = set(self.columns)
        lead = []
        for n in self.index:
            out = n + "_index" if n in data else n
            lead.append(qcol(ix(n)).alias(out))
        return self.df.select(*lead, *[qcol(c) for c in self.columns])


def like(x, t: Table):
    """Return ``t`` in the same kind as the caller's input ``x``."""
    marked_clean(t.df)
    if isinstance(x, Table):
        return t
    return marked_clean(t.to_df())
