"""Logical column types carried in StructField metadata.

Five logical types: String, Numeric, Nominal, Ordinal, Datetime. Anything
else is ``Other`` and is passed through untouched. Nominal and Ordinal are
stored as strings; their category list (ordered for Ordinal) lives in the
field metadata under ``ltype`` / ``categories``, or, if long, in a stored table
that ``category_table`` names. Metadata is lost by computed
expressions, so every operator re-attaches it with :func:`typed`.
"""

from __future__ import annotations

from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import qcol


class LType(str, Enum):
    STRING = "string"
    NUMERIC = "numeric"
    NOMINAL = "nominal"
    ORDINAL = "ordinal"
    DATETIME = "datetime"
    OTHER = "other"

    def __repr__(self):  # pragma: no cover - cosmetic
        return self.value


CATEGORICAL = frozenset({LType.NOMINAL, LType.ORDINAL})
STRINGLIKE = frozenset({LType.STRING, LType.NOMINAL, LType.ORDINAL})
ALL_TYPES = frozenset(LType) - {LType.OTHER}

_NUMERIC_SPARK = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                  T.DoubleType, T.DecimalType, T.BooleanType)
_TIME_SPARK = (T.TimestampType, T.TimestampNTZType, T.DateType)


def ltype_of_field(field: T.StructField) -> LType:
    md = field.metadata or {}
    tag = md.get("ltype")
    if isinstance(field.dataType, T.StringType):
        if tag == LType.ORDINAL.value:
            return LType.ORDINAL
        if tag == LType.NOMINAL.value:
            return LType.NOMINAL
        return LType.STRING
    if isinstance(field.dataType, _NUMERIC_SPARK):
        # 0/1 indicator columns of one-hot encoding are Nominal integers
        return LType.NOMINAL if tag == LType.NOMINAL.value else LType.NUMERIC
    if isinstance(field.dataType, _TIME_SPARK):
        return LType.DATETIME
    return LType.OTHER


def field_of(df: DataFrame, name: str) -> T.StructField:
    for f in df.schema.fields:
        if f.name == name:
            return f
    raise KeyError(name)


def ltype(df: DataFrame, name: str) -> LType:
    return ltype_of_field(field_of(df, name))


def ltypes(df: DataFrame) -> dict[str, LType]:
    return {f.name: ltype_of_field(f) for f in df.schema.fields}


def categories(df: DataFrame, name: str) -> list[str] | None:
    md = field_of(df, name).metadata or {}
    cats = md.get("categories")
    return list(cats) if cats is not None else None


def category_source(field: T.StructField) -> list[str] | dict | None:
    """The category list, ``{"table": path}`` if it is a stored table, or None."""
    md = field.metadata or {}
    if md.get("category_table") is not None:
        return {"table": md["category_table"]}
    return list(md["categories"]) if md.get("categories") is not None else None


def meta(lt: LType, cats=None) -> dict:
    if lt in CATEGORICAL:
        if isinstance(cats, dict):  # more categories than metadata should hold
            return {"ltype": lt.value, "category_table": cats["table"]}
        return {"ltype": lt.value} if cats is None else {"ltype": lt.value, "categories": list(cats)}
    return {}


def typed(expr: Column, name: str, lt: LType, cats=None) -> Column:
    """``expr`` aliased to ``name`` with logical-type metadata attached."""
    return expr.alias(name, metadata=meta(lt, cats))


def category_code(c: Column, cats: list[str]) -> Column:
    """Position of the value in a short category list, NULL when missing or unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in cats]), c), F.lit(0)) - 1


def canonicalize(df: DataFrame) -> DataFrame:
    """NaN -> NULL for float/double columns: NULL is the only missing value."""
    exprs = []
    changed = False
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.nanvl(qcol(f.name), F.lit(None).cast(f.dataType))
                         .alias(f.name, metadata=f.metadata))
            changed = True
        else:
            exprs.append(qcol(f.name))
    return df.select(*exprs) if changed else df
