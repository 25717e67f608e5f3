"""Registry of the named queries run by ``__spark_entry__`` and ``bench.py``.

Each query is a function ``(spark, sf_dir) -> DataFrame`` built from the
engine's steps over the driver tables, with an optional DuckDB SQL string
that computes the same result (the correctness oracle). Derived doubles are
rounded to 4 places on both sides; counts and labels are cast explicitly.

NULLs are injected by value predicates (never by dropping rows): the test
tables contain none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ltypes import canonicalize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return canonicalize(spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet"))


def r4(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 4)


def load_all():
    """Import every catalogue module (each registers its queries)."""
    import importlib
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
    return QUERIES, ORACLE


MODULES = ["cat_flow", "cat_columns", "cat_missing", "cat_joins", "cat_profile", "cat_convert",
           "cat_discretize", "cat_scale", "cat_compare", "cat_reshape", "cat_io"]
