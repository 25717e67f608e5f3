"""Typed save and load as Parquet.

Spark keeps StructField metadata (logical types, category lists) in the
Parquet footer, so a round trip keeps every logical type. Categories too many
for the footer are a side table in a hidden folder of the dataset, which the
footer names relative to it: the dataset can be moved, and needs nothing else.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.category_table import open_table
from ..ltypes import canonicalize, category_source
from ..names import qcol, qcols
from ..table import IX, Table


#: Hidden from readers of the rows (names that begin with an underscore are not data).
SIDE = "_categories"


def _inside(path: str, f):
    """Field ``f`` read from ``path`` with its side table named in full."""
    name = (f.metadata or {}).get("category_table")
    return {**f.metadata, "category_table": f"{path}/{name}"} if name and name.startswith(SIDE + "/") else f.metadata


def read_table(spark: SparkSession, path: str, columns=None, canonical: bool = True) -> Table:
    df = spark.read.parquet(path)
    df = df.select(*[qcol(f.name).alias(f.name, metadata=_inside(path.rstrip("/"), f)) for f in df.schema.fields])
    index = [c[len(IX):] for c in df.columns if c.startswith(IX)]
    if columns is not None:
        df = df.select(*qcols([IX + n for n in index]), *qcols(columns))
    if canonical:
        df = canonicalize(df)
    return Table(df, tuple(index))


def read_parquet(spark: SparkSession, path: str, columns=None) -> DataFrame:
    return read_table(spark, path, columns).to_df()


def write_table(x, path: str, mode: str = "overwrite", partition_by=None,
                max_records_per_file: int | None = None) -> None:
    """Rows, logical types and categories, whole in the folder ``path``."""
    t, path = Table.of(x), path.rstrip("/")
    side, exprs = {}, []
    for f in t.df.schema.fields:
        cats = category_source(f)
        if isinstance(cats, dict):  # one copy of a table that several columns name
            name = side.setdefault(cats["table"], f"{SIDE}/{uuid.uuid4().hex}")
            exprs.append(qcol(f.name).alias(f.name, metadata={**f.metadata, "category_table": name}))
        else:
            exprs.append(qcol(f.name))
    w = t.df.select(*exprs).write.mode(mode)
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)  # first: overwriting empties the folder
    for table, name in side.items():
        open_table(t.df.sparkSession, {"table": table}).write.parquet(f"{path}/{name}")
