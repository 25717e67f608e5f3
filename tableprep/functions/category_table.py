"""Stored category tables ``(v, code)`` for columns with more categories than metadata lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..names import qcol
from .store import stored, stored_at

SCHEMA = "v string, code int"


def numbered(values: DataFrame, by: str) -> DataFrame:
    """``(v, code)``: the values (each once) and their positions in the order of ``by``.

    Sorted over range partitions; a value's position is its row in its
    partition plus the rows of the partitions before (one number each on the driver).
    """
    # the written rows fix the partitions, so that counts and rows agree
    rows = stored(values.orderBy(by).select("v", F.monotonically_increasing_id().alias("at")))
    part, row = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p_, n in sizes:
        before.append((p_, total))
        total += n
    first = values.sparkSession.createDataFrame(before, "p long, before long")
    return rows.withColumn("p", part).join(first, "p").select("v", (F.col("before") + row).cast("int").alias("code"))


def keep(codes: DataFrame) -> dict:
    """Stores ``(v, code)`` and returns what refers to it in a column's metadata and in learned parameters."""
    return {"table": stored_at(codes.select("v", "code"))}


def open_table(spark, ref: dict) -> DataFrame:
    """``(v, code)`` of a reference."""
    if ref["table"].startswith("_"):
        raise SchemaError("categories lie beside the rows of a saved table: read it with read_table")
    return spark.read.schema(SCHEMA).parquet(ref["table"])


def with_code(df: DataFrame, column: str, codes: DataFrame, code: str) -> DataFrame:
    """``df`` with the position of ``column`` in ``codes`` as column ``code``, NULL when missing or unknown."""
    v = f"{code}_v"
    return df.join(codes.select(F.col("v").alias(v), F.col("code").alias(code)), qcol(column) == F.col(v), "left").drop(v)


def replaced(codes: DataFrame, steps, inverted: bool) -> DataFrame:
    """``(v, code)`` after the replacements ``(listed values, new value)`` in turn: as a list of categories would change,
    a category stands where the first of those that became it stood, and an inverted replacement comes last."""
    rows = codes.select("v", F.col("code").cast("long").alias("at"))
    for k, (vals, new) in enumerate(steps):
        listed = F.col("v").isin(vals) if vals else F.lit(False)
        rows = rows.select(F.when(~listed if inverted else listed, F.lit(new).cast("string")).otherwise(F.col("v")).alias("v"), "at")
        rows = rows.where(F.col("v").isNotNull())
        if inverted and new is not None:
            rows = rows.union(codes.sparkSession.range(1).select(F.lit(new).alias("v"), F.lit((1 << 40) + k).alias("at")))
    return numbered(rows.groupBy("v").agg(F.min("at").alias("at")), "at")
