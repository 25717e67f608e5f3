"""Summaries of numeric columns that answer several fits of a chain at once.

Filling with the mean, min-max and standard scaling learn nothing but counts,
means, extremes and deviations, and what filling does to these follows without
looking at the rows again. So one aggregate before a chain of such steps fits
all of them. A summary is ``{column: {rows, n, mean, min, max, std}}``.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..names import qcol


def measure(df, cols) -> dict[str, dict]:
    """Summaries of the columns, from one aggregate."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(cols):
        x = qcol(c).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                 F.stddev_pop(x).alias(f"std{i}")]
    row = df.agg(*aggs).collect()[0]
    return {c: {"rows": row["rows"], **{k: row[f"{k}{i}"] for k in ("n", "mean", "min", "max", "std")}} for i, c in enumerate(cols)}


def filled(s: dict, value: float | None) -> dict:
    """The summary after missing values became ``value`` (None: they stay), the mean of the others."""
    if value is None or s["n"] == s["rows"]:
        return s
    return {"rows": s["rows"], "n": s["rows"], "mean": s["mean"], "min": min(s["min"], value), "max": max(s["max"], value),
            "std": s["std"] * math.sqrt(s["n"] / s["rows"])}
