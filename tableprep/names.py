"""Column names as they are: dots and backticks belong to the name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def qcol(name: str) -> Column:
    """The top-level column of exactly this name."""
    return F.col(quoted(name))


def qcols(names) -> list[Column]:
    return [qcol(n) for n in names]
