"""Learned parameters and options as JSON, with their stored tables beside it.

A parameter is made of JSON's own types, times and decimals, and references
``{"table": path}`` to stored tables. Anything else is an error when it is
saved, not a surprise when it is loaded.
"""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

#: Name of the text file and folder of the tables inside a saved folder.
TEXT, TABLES = "graph", "tables"
_KIND = "__kind__"


def _plain(x):
    """JSON's own types; what they cannot express is marked with its kind."""
    if isinstance(x, dict):
        bad = [k for k in x if not isinstance(k, str)]
        if bad:
            raise TypeError(f"cannot be saved: key {bad[0]!r} is not text")
        return {k: _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, datetime):
        return {_KIND: "datetime", "value": x.isoformat()}
    if isinstance(x, date):
        return {_KIND: "date", "value": x.isoformat()}
    if isinstance(x, Decimal):
        return {_KIND: "decimal", "value": str(x)}
    if x is None or isinstance(x, (str, bool, int, float)):
        return x
    raise TypeError(f"cannot be saved: {type(x).__name__}")


def _rich(x):
    if isinstance(x, list):
        return [_rich(v) for v in x]
    if isinstance(x, dict):
        if _KIND in x:
            return {"datetime": datetime.fromisoformat, "date": date.fromisoformat, "decimal": Decimal}[x[_KIND]](x["value"])
        return {k: _rich(v) for k, v in x.items()}
    return x


def dumps(x) -> str:
    return json.dumps(_plain(x), sort_keys=True)


def loads(text: str):
    return _rich(json.loads(text))


def is_table(x) -> bool:
    """Whether a parameter is a reference to a stored table."""
    return isinstance(x, dict) and set(x) == {"table"} and isinstance(x["table"], str)


def _tables(x, change):
    """``x`` with every reference replaced by ``change(reference)``."""
    if is_table(x):
        return change(x)
    if isinstance(x, dict):
        return {k: _tables(v, change) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_tables(v, change) for v in x]
    return x


def save(spark: SparkSession, path: str, doc: dict) -> None:
    """A folder with the text of ``doc`` and copies of the tables its learned parameters (``fitted``) name."""
    path, n = path.rstrip("/"), 0

    def copy(ref):
        nonlocal n
        name, n = f"{TABLES}/{n}", n + 1
        spark.read.parquet(ref["table"]).write.parquet(f"{path}/{name}")
        return {"table": name}
    text = dumps({**doc, "fitted": _tables(doc.get("fitted") or {}, copy)})
    # made last: a folder without it is not a saved graph
    spark.range(1).select(F.lit(text).alias("value")).write.text(f"{path}/{TEXT}")


def load(spark: SparkSession, path: str) -> dict:
    """What :func:`save` wrote, the references naming the copies in this folder."""
    path = path.rstrip("/")
    rows = [r["value"] for r in spark.read.text(f"{path}/{TEXT}").collect()]  # one line
    if len(rows) != 1:
        raise ValueError(f"{path} holds no saved graph")
    doc = loads(rows[0])
    doc["fitted"] = _tables(doc.get("fitted") or {}, lambda ref: {"table": f"{path}/{ref['table']}"})
    return doc
