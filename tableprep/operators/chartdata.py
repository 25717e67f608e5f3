"""Chart data: V1 (scatter), V2 (time series). Row-local plans plus, for V2,
one aggregate for the value range. Down-sampling is the sampling feature of
the chart (``fraction``), never a way around data size."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import SchemaError
from ..functions.category_table import open_table, with_code
from ..functions.timeutil import epoch_micros
from ..ltypes import CATEGORICAL, LType, category_code, category_source, field_of, ltype_of_field, ltypes
from ..names import qcol
from ..table import Table


def _with_codes(df, cols):
    """``df`` with the codes of the columns that have a stored category table, and the code column of each."""
    codes = {}
    for c in dict.fromkeys(cols):
        f = field_of(df, c)
        cats = category_source(f) if ltype_of_field(f) in CATEGORICAL else None
        if isinstance(cats, dict):
            codes[c] = f"__code{len(codes)}"
            df = with_code(df, c, open_table(df.sparkSession, cats), codes[c])
    return df, codes


def _numeric_view(df, c, lt, codes):
    if c in codes:
        return qcol(codes[c]).cast("double")
    if lt == LType.NUMERIC:
        return qcol(c).cast("double")
    if lt in CATEGORICAL:
        cats = category_source(field_of(df, c))
        if cats is None:
            raise SchemaError(f"{c}: no category list")
        return category_code(qcol(c), cats).cast("double")
    if lt == LType.DATETIME:
        return epoch_micros(qcol(c), field_of(df, c).dataType) / 1000.0
    raise SchemaError(f"{c}: cannot be plotted ({lt.value})")


def scatter_data(x, columns, colour: str | None = None, fraction: float | None = None,
                 seed: int = 0) -> DataFrame:
    """V1: the given columns (2+) as numbers -- categories become their codes,
    datetimes epoch ms -- plus an optional colour column; rows with any missing
    value removed; optional Bernoulli down-sampling (each row alike)."""
    t = Table.of(x)
    df = t.df
    lt = ltypes(df)
    cols = list(columns)
    if len(cols) < 2:
        raise SchemaError("scatter needs at least two columns")
    df, codes = _with_codes(df, cols)
    exprs = [_numeric_view(df, c, lt[c], codes).alias(c) for c in cols]
    if colour:
        exprs.append(qcol(colour).cast("string").alias(colour))
    out = df.select(*exprs)
    out = out.where(reduce(and_, [qcol(c).isNotNull() for c in out.columns]))
    if fraction is not None:
        out = out.sample(withReplacement=False, fraction=float(fraction), seed=seed)
    return out


def series_data(x, time: str, values, ids=None, id_column: str | None = None) -> DataFrame:
    """V2: long form ``(series, t, value)``. Time: Datetime -> epoch ms,
    Ordinal -> category position; rows without time dropped. Either several
    value columns (series = column name) or one column over several ids
    (series = id value)."""
    t = Table.of(x)
    df = t.df
    lt = ltypes(df)
    values = [values] if isinstance(values, str) else list(values)
    if lt[time] not in (LType.DATETIME, LType.ORDINAL):
        raise SchemaError("time column must be Datetime or Ordinal")
    for v in values:
        if lt[v] not in (LType.NUMERIC, LType.ORDINAL):
            raise SchemaError(f"{v}: values must be Numeric or Ordinal")
    if ids is not None and len(values) > 1:
        raise SchemaError("either many columns or many ids, not both")
    df, codes = _with_codes(df, [time, *values])
    tcol = _numeric_view(df, time, lt[time], codes).alias("t")
    base = df
    if ids is not None:
        key = t.icol(t.index[0]) if id_column is None else qcol(id_column)
        if isinstance(ids, DataFrame):  # many ids: a semi join
            name = "__series_id"
            base = base.join(ids.select(qcol(ids.columns[0]).alias(name)).distinct(), key.eqNullSafe(qcol(name)), "left_semi")
        else:
            base = base.where(key.isin(list(ids)))
        series = key.cast("string")
        arr = F.array(F.struct(series.alias("series"), _numeric_view(df, values[0], lt[values[0]], codes).alias("value")))
    else:
        arr = F.array(*[F.struct(F.lit(v).alias("series"), _numeric_view(df, v, lt[v], codes).alias("value"))
                        for v in values])
    return base.select(tcol, F.inline(arr)).where(qcol("t").isNotNull()).select("series", "t", "value")


def value_range(series: DataFrame) -> DataFrame:
    """V2 range of the values (one aggregate)."""
    return series.agg(F.min("value").alias("min"), F.max("value").alias("max"))
