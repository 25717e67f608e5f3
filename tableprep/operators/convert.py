"""Type conversion: T1-T5.

All row-local ``select``s except ``ToCategorical`` without a category list,
whose fit is one distributed ``distinct``. Up to ``LISTED`` categories are
kept as a list in the column's metadata; more are kept as a stored table
(value, code) that the metadata names.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.category_table import keep, numbered
from ..functions.pyformat import INFER_FORMATS, NUMBER_RE, number, py_float_str, strptime_to_spark
from ..ltypes import CATEGORICAL, LType, STRINGLIKE, category_source, field_of, ltype_of_field, typed
from ..names import qcol
from ..step import Step, register


#: Categories a column's metadata lists at most.
LISTED = 10_000


def _cols(opts, key="attributes"):
    a = opts.get(key)
    return list(a) if a else []


def as_text(field: T.StructField):
    """Value as text the way the reference prints it (ints were floats there)."""
    c = qcol(field.name)
    lt = ltype_of_field(field)
    if lt == LType.NUMERIC:
        if isinstance(field.dataType, T.BooleanType):
            return F.when(c, F.lit("True")).when(~c, F.lit("False"))
        return py_float_str(c)
    return c.cast("string")


@register
class ToNumeric(Step):
    """Text or categories to double. ``errors='raise'`` fails the job on
    a value that is not a number; ``'coerce'`` gives NULL."""
    key = "to_numeric"
    accepts = STRINGLIKE

    def check(self):
        if not self.options.get("attributes"):
            yield ("not_given", "no column selected")
        if self.options.get("errors", "raise") not in ("raise", "coerce"):
            yield ("errors", "errors must be raise or coerce")

    def input_columns(self):
        return _cols(self.options)

    def _transform(self, t, params):
        sel = set(_cols(self.options))
        coerce = self.options.get("errors", "raise") == "coerce"
        exprs = []
        for f in t.df.schema.fields:
            if f.name in sel:
                raw = qcol(f.name)
                ok = raw.rlike(NUMBER_RE)
                num = number(raw)
                if coerce:
                    e = num
                else:  # fails the job on a bad value, whatever the ANSI setting
                    e = F.when(raw.isNotNull() & ~ok, F.raise_error(F.concat(
                        F.lit(f"to_numeric: cannot parse {f.name} value "), raw)).cast("double")).otherwise(num)
                exprs.append(typed(e, f.name, LType.NUMERIC))
            else:
                exprs.append(qcol(f.name))
        return t.with_df(t.df.select(*exprs))


@register
class ToCategorical(Step):
    """``attributes {col: {"cat": [..] | None, "ordered": bool}}``. Values
    become text (missing kept); with a list, values outside it become missing
    and the list order is the category order; without, all distinct values
    sorted as text."""
    key = "to_categorical"
    accepts = frozenset({LType.STRING, LType.NUMERIC, LType.NOMINAL, LType.ORDINAL})

    def check(self):
        if not self.options.get("attributes"):
            yield ("not_given", "no column selected")
        for c, o in (self.options.get("attributes") or {}).items():
            cats = (o or {}).get("cat")
            if cats is not None and len(set(cats)) != len(cats):
                yield ("unique", f"categories of {c} repeat")

    def input_columns(self):
        return _cols(self.options)

    @property
    def streaming(self):  # type: ignore[override]
        return "fit"

    def needs_fit(self):
        return any((o or {}).get("cat") is None for o in self.options["attributes"].values())

    def _fit(self, t):
        cap = self.options.get("max_categories")  # an error above it, only if asked for
        learned = {}
        for c, o in self.options["attributes"].items():
            if (o or {}).get("cat") is not None:
                learned[c] = list(o["cat"])
                continue
            f = field_of(t.df, c)
            if ltype_of_field(f) in CATEGORICAL:  # Nominal <-> Ordinal keeps the category list
                learned[c] = category_source(f)
                continue
            most = LISTED if cap is None else int(cap)
            distinct = t.df.select(as_text(f).alias("v")).where(qcol("v").isNotNull()).distinct()
            vals = distinct.limit(most + 1).collect()
            if len(vals) > most and cap is not None:
                raise SchemaError(f"to_categorical: {c} has more than {cap} distinct values")
            learned[c] = sorted(r["v"] for r in vals) if len(vals) <= most else keep(numbered(distinct, "v"))
        return {"categories": learned}

    def _transform(self, t, params):
        attrs = self.options["attributes"]
        learned = params.get("categories", {})
        exprs = []
        for f in t.df.schema.fields:
            if f.name in attrs:
                o = attrs[f.name] or {}
                cats = o.get("cat") if o.get("cat") is not None else learned[f.name]
                txt = as_text(f)
                e = F.when(txt.isin(list(cats)), txt) if o.get("cat") is not None else txt
                lt = LType.ORDINAL if o.get("ordered") else LType.NOMINAL
                exprs.append(typed(e, f.name, lt, cats))
            else:
                exprs.append(qcol(f.name))
        return t.with_df(t.df.select(*exprs))


@register
class ToTimestamp(Step):
    """T4: text to datetime. ``attributes {col: {"format": strptime | None}}``;
    ``errors='raise'`` fails on a bad value, ``'coerce'`` gives NULL. Without a
    format, a fixed list of formats is tried in order."""
    key = "to_timestamp"
    accepts = frozenset({LType.STRING})

    def check(self):
        if not self.options.get("attributes"):
            yield ("not_given", "no column selected")
        if self.options.get("errors", "raise") not in ("raise", "coerce"):
            yield ("errors", "errors must be raise or coerce")
        for c, o in (self.options.get("attributes") or {}).items():
            fmt = (o or {}).get("format")
            if fmt:
                try:
                    strptime_to_spark(fmt)
                except ValueError as e:
                    yield ("format", f"{c}: {e}")

    def input_columns(self):
        return _cols(self.options)

    def _transform(self, t, params):
        attrs = self.options["attributes"]
        coerce = self.options.get("errors", "raise") == "coerce"
        exprs = []
        for f in t.df.schema.fields:
            if f.name in attrs:
                fmt = (attrs[f.name] or {}).get("format")
                fmts = [fmt] if fmt else INFER_FORMATS
                c = qcol(f.name)
                # validate with the lenient parser, then parse the wall clock
                # straight to TIMESTAMP_NTZ (no session-zone step in between)
                tries = [F.when(F.try_to_timestamp(c, F.lit(strptime_to_spark(x))).isNotNull(),
                                F.to_timestamp_ntz(c, F.lit(strptime_to_spark(x)))) for x in fmts]
                parsed = F.coalesce(*tries) if len(tries) > 1 else tries[0]
                if not coerce:
                    bad = c.isNotNull() & parsed.isNull()
                    parsed = F.when(bad, F.raise_error(F.concat(
                        F.lit(f"to_timestamp: cannot parse {f.name} value "), c))).otherwise(parsed)
                exprs.append(typed(parsed.cast("timestamp_ntz"), f.name, LType.DATETIME))
            else:
                exprs.append(qcol(f.name))
        return t.with_df(t.df.select(*exprs))


@register
class ToString(Step):
    """T5: to text, missing stays missing; numbers in Python layout."""
    key = "to_string"
    accepts = frozenset({LType.NUMERIC, LType.ORDINAL, LType.NOMINAL, LType.DATETIME})

    def check(self):
        if not self.options.get("attributes"):
            yield ("not_given", "no column selected")

    def input_columns(self):
        return _cols(self.options)

    def _transform(self, t, params):
        sel = set(_cols(self.options))
        exprs = [typed(as_text(f), f.name, LType.STRING) if f.name in sel else qcol(f.name)
                 for f in t.df.schema.fields]
        return t.with_df(t.df.select(*exprs))


def to_ordinal(df, column: str, cats: list[str]):
    """Mark a text column Ordinal with a given category order (no data pass)."""
    return ToCategorical(attributes={column: {"cat": cats, "ordered": True}})(df)


__all__ = ["ToNumeric", "ToCategorical", "ToTimestamp", "ToString", "as_text", "to_ordinal"]
