"""Value replacement: R1 (listed values) and R2 (inverted: everything not listed).

Lists are applied in sequence, later ones see earlier results, as a fold of
``when(cond, new).otherwise(prev)``; a replacement or a listed value may be
missing (``None``; ``"nan"`` in a Numeric column). Category lists in the
field metadata are carried through the same fold, stored category tables too.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.category_table import keep, open_table, replaced
from ..ltypes import CATEGORICAL, LType, category_source, ltype_of_field, typed
from ..names import qcol
from ..step import Step, register


def _num(v):
    """Numeric token or None for missing; non-numeric tokens are ignored (KeyError)."""
    if v is None:
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if isinstance(v, float) and math.isnan(v) else float(v)
    s = str(v).strip()
    if s.lower() == "nan":
        return None
    try:
        return float(s)
    except ValueError:
        raise KeyError(s)


def _norm(values, numeric):
    """(non-missing values, missing listed?)"""
    vals, has_missing = [], False
    for v in values:
        if numeric:
            try:
                n = _num(v)
            except KeyError:
                continue
            if n is None:
                has_missing = True
            else:
                vals.append(n)
        else:
            if v is None:
                has_missing = True
            else:
                vals.append(str(v))
    return vals, has_missing


@register
class ReplaceValues(Step):
    """``table {col: {"values": [[...], ...], "replace": [...]}}, inverted``."""
    key = "replace_values"
    accepts = frozenset({LType.STRING, LType.ORDINAL, LType.NOMINAL, LType.NUMERIC})

    def check(self):
        table = self.options.get("table") or {}
        if not table:
            yield ("not_given", "no column selected")
        for c, o in table.items():
            if len(o.get("values", [])) != len(o.get("replace", [])):
                yield ("len", f"{c}: one replacement per list of values")

    def input_columns(self):
        return list(self.options["table"])

    def _transform(self, t, params):
        table = self.options["table"]
        inverted = bool(self.options.get("inverted", False))
        exprs = []
        for f in t.df.schema.fields:
            if f.name not in table:
                exprs.append(qcol(f.name))
                continue
            lt = ltype_of_field(f)
            numeric = lt == LType.NUMERIC
            c = qcol(f.name).cast("double") if numeric and f.dataType.typeName() != "double" else qcol(f.name)
            cats = category_source(f) if lt in CATEGORICAL else None
            cur, steps = c, []
            for values, rep in zip(table[f.name]["values"], table[f.name]["replace"]):
                vals, has_missing = _norm(values, numeric)
                listed = F.coalesce(cur.isin(vals), F.lit(False)) if vals else F.lit(False)
                if has_missing:
                    listed = listed | cur.isNull()
                cond = ~listed if inverted else listed
                if numeric:
                    r = _num(rep)
                    new = F.lit(r).cast("double")
                else:
                    r = None if rep is None else str(rep)
                    new = F.lit(r).cast("string")
                cur = F.when(cond, new).otherwise(cur)
                steps.append((vals, r))
                if isinstance(cats, list):
                    cats = _replace_categories(cats, vals, has_missing, r, inverted)
            if isinstance(cats, dict) and steps:
                cats = keep(replaced(open_table(t.df.sparkSession, cats), steps, inverted))
            if numeric:
                exprs.append(typed(cur, f.name, LType.NUMERIC))
            elif cats is not None:
                exprs.append(typed(cur, f.name, lt, cats))
            else:
                exprs.append(typed(cur, f.name, LType.STRING))
        return t.with_df(t.df.select(*exprs))


def _replace_categories(cats, vals, has_missing, rep, inverted):
    out = []
    for x in cats:
        hit = x in vals
        if inverted:
            hit = not hit
        y = rep if hit else x
        if y is not None and y not in out:
            out.append(y)
    if inverted and rep is not None and rep not in out:
        out.append(rep)
    return out
