"""Named tables: S9 (input by name), S10 (output by name), S12 (paged head),
plus listing, renaming and removing names -- all ``spark.catalog`` calls.

Index levels are stored as prefixed columns, so a named table keeps its
index through a temp view or a saved table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OptionError
from ..functions.buckets import with_count_below
from ..functions.store import stored
from ..functions.timeutil import epoch_micros
from ..names import qcol, qcols
from ..operators.fill import range_edges
from ..table import IX, Table


def set_input(spark: SparkSession, name: str) -> Table:
    """The named table (temp view or catalog table) as a Table."""
    df = spark.table(name)
    index = tuple(c[len(IX):] for c in df.columns if c.startswith(IX))
    return Table(df, index)


def to_variable(x, name: str, persistent: bool = False) -> None:
    """Store under ``name``, overwriting: the rows are computed and written
    once, under the cluster's shared folder (a temp view names them) or, with
    ``persistent=True``, as a managed table that survives the session."""
    if not name:
        raise OptionError([("empty_name", "name must not be empty")])
    t = Table.of(x)
    if t.df.isStreaming:
        raise OptionError([("stream", "use to_stream_table for a streaming DataFrame")])
    if persistent:
        t.df.write.mode("overwrite").saveAsTable(name)
    else:
        stored(t.df).createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    names = set(list_tables(spark))
    if not new or new == old:
        raise OptionError([("empty_name", "new name must be non-empty and different")])
    if new in names:
        raise OptionError([("taken", f"{new} exists")])
    if old not in names:
        raise OptionError([("missing", f"no table {old}")])
    if spark.catalog.tableExists(old) and not _is_temp(spark, old):
        spark.sql(f"ALTER TABLE `{old}` RENAME TO `{new}`")
    else:
        spark.table(old).createOrReplaceTempView(new)
        spark.catalog.dropTempView(old)


def remove_table(spark: SparkSession, name: str) -> None:
    if _is_temp(spark, name):
        spark.catalog.dropTempView(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")


def _is_temp(spark, name):
    return any(t.name == name and t.isTemporary for t in spark.catalog.listTables())


#: Pages that begin beyond this row look for the range of rows that holds them first.
NEAR = 10_000


def head(x, n: int = 400, offset: int = 0, order_by=None, columns=None, column_offset: int = 0,
         page_columns: int = 50, near: int = NEAR) -> DataFrame:
    """One page of rows and columns. Spark rows have no order, so a page
    needs ``order_by``; missing keys come first.

    A page near the beginning is a top-k of ``offset + n`` rows. A deeper one in
    the order of a number or time first counts the rows of ranges of that key
    (two small aggregates); only the rows of the ranges that hold the page are
    then sorted, so the work beyond the scan does not grow with the offset.
    """
    t = Table.of(x)
    df = t.to_df()
    cols = list(columns) if columns is not None else df.columns[column_offset:column_offset + page_columns]
    keys = [order_by] if isinstance(order_by, str) else list(order_by or [])
    if not keys:
        raise OptionError([("order", "a page needs order_by")])
    if offset + n > near:
        df, offset = _ranges_of_page(df, keys[0], int(offset), int(n))
    out = df.orderBy(*[qcol(k) for k in keys])
    if offset:
        out = out.offset(int(offset))
    return out.limit(int(n)).select(*qcols(cols))


def _ranges_of_page(df: DataFrame, key: str, offset: int, n: int) -> tuple[DataFrame, int]:
    """The rows of the ranges of ``key`` that hold rows ``offset`` to ``offset + n``, and the page's offset among them."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        number = epoch_micros(qcol(key), kind)
    elif isinstance(kind, T.NumericType):
        number = qcol(key).cast("double") if isinstance(kind, (T.FloatType, T.DecimalType)) else qcol(key)
    else:
        return df, offset  # other keys: a top-k
    marked = with_count_below(df.withColumn("__number", number), qcol("__number"),
                              range_edges(df, number, min_ranges=RANGES, rows_per_range=ROWS_PER_RANGE), "__range", strict=False)
    marked = marked.withColumn("__range", F.coalesce(F.col("__range"), F.lit(-1)))  # missing keys come first
    before, wanted, start = 0, [], 0
    for r in sorted(marked.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["__range"]):
        if before < offset + n and before + r["n"] > offset:
            start = before if not wanted else start
            wanted.append(r["__range"])
        before += r["n"]
    rows = marked.where(F.col("__range").between(min(wanted), max(wanted)) if wanted else F.lit(False))
    return rows.drop("__number", "__range"), offset - start


#: Ranges that a deep page is looked for in: at least so many, of about so many rows.
RANGES, ROWS_PER_RANGE = 64, 1_000_000
