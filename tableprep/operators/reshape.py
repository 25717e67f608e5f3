"""Extract time series (wide -> long panel).

``series {name: [(frame, column, label), ...]}``, ``time`` = labels in order.
Frames are keyed by a single id (index level or ``id`` option). Output: one
row per (id, label) for every id of any frame, one column per series,
``time`` Ordinal in the given label order.

Plan: the frames are unioned (one row per id and frame, only the needed
columns), grouped once by id -- a single shuffle whatever the number of
frames, at most one row per frame in a group -- then ONE ``inline`` of an
array of per-label structs gives every (id, label) without a cross join or a
scan per column. A repeated id in a frame raises at run time, also with one
frame (only a single streaming frame is not checked: no grouping there).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..errors import OptionError
from ..functions.pyformat import py_float_str
from ..ltypes import LType, ltype_of_field, field_of, typed
from ..names import qcol
from ..table import Table, ix


def _check(series, time):
    errors = []
    if not series:
        errors.append(("no_series", "no series given"))
    if not time:
        errors.append(("no_labels", "no time labels given"))
    if len(set(time or [])) != len(time or []):
        errors.append(("duplicates", "time labels repeat"))
    for name, parts in (series or {}).items():
        if not name:
            errors.append(("empty_name", "series without a name"))
        labels = [p[2] for p in parts]
        if len(set(labels)) != len(labels):
            errors.append(("duplicates", f"{name}: a label is used twice"))
        if len(labels) != len(time or []) or set(labels) != set(time or []):
            errors.append(("length", f"{name}: needs exactly one column per time label"))
    if errors:
        raise OptionError(errors)


def extract_series(frames: dict, series: dict, time: list, id_name: str | None = None,
                   time_name: str = "time"):
    """``frames``: name -> Table (single index) or DataFrame (then ``id_name``)."""
    _check(series, time)
    used = {}
    for name, parts in series.items():
        for f, c, _ in parts:
            used.setdefault(f, [])
            if c not in used[f]:
                used[f].append(c)
    tabs = {f: Table.of(frames[f]) for f in used}

    def idcol(t: Table):
        if id_name is not None and id_name in t.columns:
            return id_name, qcol(id_name)
        if len(t.index) != 1:
            raise OptionError([("index", "each frame needs a single id")])
        return t.index[0], t.icol(t.index[0])

    id_out = id_name or idcol(next(iter(tabs.values())))[0]
    # one value type per series: text if any source column is text
    stype = {}
    for name, parts in series.items():
        kinds = {ltype_of_field(field_of(tabs[f].df, c)) for f, c, _ in parts}
        stype[name] = LType.NUMERIC if kinds <= {LType.NUMERIC} else (
            LType.DATETIME if kinds == {LType.DATETIME} else LType.STRING)

    def value(col, f, c, name):
        if stype[name] == LType.STRING:
            fld = field_of(tabs[f].df, c)
            return py_float_str(col) if ltype_of_field(fld) == LType.NUMERIC else col.cast("string")
        if stype[name] == LType.NUMERIC:
            return col.cast("double")
        return col

    names = list(tabs)
    if len(names) == 1 and tabs[names[0]].is_streaming:
        f = names[0]
        t = tabs[f]
        _, key = idcol(t)
        # a stream cannot be grouped here: its ids are the caller's promise
        wide = t.df.select(key.alias("__id"), *[qcol(c).alias(f"{f}__{c}") for c in used[f]])
        cnt_cols = {}
    else:
        parts = []
        for i, f in enumerate(names):
            t = tabs[f]
            _, key = idcol(t)
            sel = [key.alias("__id"), F.lit(i).alias("__frame")]
            for g in names:
                for c in used[g]:
                    src = qcol(c) if g == f else F.lit(None)
                    sel.append(src.cast(field_of(tabs[g].df, c).dataType).alias(f"{g}__{c}"))
            parts.append(t.df.select(*sel))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        aggs = [F.max(qcol(f"{g}__{c}")).alias(f"{g}__{c}") for g in names for c in used[g]]
        aggs += [F.count_if(qcol("__frame") == i).alias(f"__n{i}") for i in range(len(names))]
        wide = u.groupBy("__id").agg(*aggs)
        cnt_cols = {i: f"__n{i}" for i in range(len(names))}
    guard = None
    for i, cc in cnt_cols.items():
        term = qcol(cc) > 1
        guard = term if guard is None else guard | term
    structs = []
    for lab in time:
        fields = [F.lit(str(lab)).alias(time_name)]
        for name, parts in series.items():
            f, c = next((p[0], p[1]) for p in parts if p[2] == lab)
            fields.append(value(qcol(f"{f}__{c}"), f, c, name).alias(name))
        structs.append(F.struct(*fields))
    key = qcol("__id")
    if guard is not None:
        key = F.when(guard, F.raise_error(F.lit("extract_series: an id repeats in a frame"))).otherwise(key)
    long = wide.select(key.alias("__id"), F.inline(F.array(*structs)))
    out = long.select(qcol("__id").alias(ix(id_out)),
                      typed(qcol(time_name), ix(time_name), LType.ORDINAL, [str(x) for x in time]),
                      *[qcol(n) for n in series])
    return Table(out, (id_out, time_name))
