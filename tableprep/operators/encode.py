"""Encoding: C3 (one-hot), C4 (category codes), C5 (timestamp to epoch ms)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..functions.category_table import keep, numbered, open_table, with_code
from ..functions.timeutil import epoch_micros
from ..ltypes import CATEGORICAL, LType, category_code, category_source, field_of, ltype, meta, typed
from ..names import qcol, quoted
from ..step import Step, register
from ..table import Table


def distinct_values(df, column: str, cap: int | None = None) -> list[str]:
    """Sorted distinct non-missing values; with ``cap``, an error above it
    (then at most ``cap + 1`` rows are brought back)."""
    vals = df.select(qcol(column).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    rows = (vals if cap is None else vals.limit(int(cap) + 1)).collect()
    if cap is not None and len(rows) > int(cap):
        raise SchemaError(f"{column}: more than {cap} distinct values")
    return sorted(r["v"] for r in rows)


#: Categories looked up in a literal list; more are looked up by a join.
LITERAL = 64


def code_table(df, column: str):
    """``(v, code)``: the sorted distinct non-missing values and their positions."""
    vals = df.select(qcol(column).cast("string").alias("v")).where(F.col("v").isNotNull()).distinct()
    return numbered(vals, "v")


def learned_categories(t, column: str):
    """The categories of a column, else its sorted distinct values: a list, or a reference to a stored table if they are many."""
    cats = category_source(field_of(t.df, column)) if ltype(t.df, column) in CATEGORICAL else None
    if cats is not None:
        return cats
    few = t.df.select(qcol(column)).where(qcol(column).isNotNull()).distinct().limit(LITERAL + 1).count()
    return distinct_values(t.df, column) if few <= LITERAL else keep(code_table(t.df, column))


def with_codes(df, categories: dict, name: str):
    """``df`` and, for each column of ``categories``, an expression of its position in them (NULL: missing or unknown).

    Short lists are looked up in place, long ones by a join that adds a column ``<name><i>``.
    """
    codes = {}
    for i, (c, x) in enumerate(categories.items()):
        if isinstance(x, list) and len(x) <= LITERAL:
            codes[c] = category_code(qcol(c), x).cast("int")
            continue
        x = (df.sparkSession.createDataFrame([(v, j) for j, v in enumerate(x)], "v string, code int")
             if isinstance(x, list) else open_table(df.sparkSession, x))
        df = with_code(df, c, x, f"{name}{i}")
        codes[c] = qcol(f"{name}{i}").cast("int")
    return df, codes


@register
class OneHotEncoder(Step):
    """``attributes, include_nan``. Appends ``<col>_<value>`` 0/1 Nominal
    columns per value (category order, else sorted), plus ``<col>_nan`` when
    asked; originals kept; same-named columns are replaced where they stand.

    ``output="sparse"`` appends one column ``<col>_onehot`` instead, of any
    width: ``(size, index)``, where ``index`` is the position of the one among
    ``size`` places (NULL: none is one; with ``include_nan`` the last place is for
    missing). Its metadata keeps the categories; :func:`expand_onehot` makes
    columns of those asked for."""
    key = "onehot_encoder"
    streaming = "fit"
    accepts = frozenset({LType.ORDINAL, LType.NOMINAL, LType.STRING})

    def check(self):
        if not self.options.get("attributes"):
            yield ("no_columns", "no column selected")
        if self.options.get("output", "columns") not in ("columns", "sparse"):
            yield ("output", "output must be columns or sparse")

    def input_columns(self):
        return list(self.options["attributes"])

    def needs_fit(self):
        return True

    def _fit(self, t):
        cap = self.options.get("max_categories")  # an error above it, only if asked for
        if self.options.get("output") == "sparse":
            found = {c: learned_categories(t, c) for c in self.options["attributes"]}
            sizes = {c: len(x) if isinstance(x, list) else open_table(t.df.sparkSession, x).count() for c, x in found.items()}
            for c, n in sizes.items():
                if cap is not None and n > int(cap):
                    raise SchemaError(f"onehot: {c} has more than {cap} categories")
            return {"categories": found, "sizes": sizes}
        values = {}
        for c in self.options["attributes"]:
            cats = category_source(field_of(t.df, c)) if ltype(t.df, c) in CATEGORICAL else None
            if isinstance(cats, dict):
                codes = open_table(t.df.sparkSession, cats)
                most = codes if cap is None else codes.limit(int(cap) + 1)
                cats = [r["v"] for r in sorted(most.collect(), key=lambda r: r["code"])]
            values[c] = list(cats) if cats is not None else distinct_values(t.df, c, cap)
            if cap is not None and len(values[c]) > int(cap):
                raise SchemaError(f"onehot: {c} has more than {cap} categories")
        return {"values": values}

    def _transform(self, t, params):
        include_nan = bool(self.options.get("include_nan", False))
        if self.options.get("output") == "sparse":
            return self._sparse(t, params, include_nan)
        produced = {}
        for c in self.options["attributes"]:
            for v in params["values"][c]:
                produced[f"{c}_{v}"] = f"CAST(coalesce({quoted(c)} = {literal(v)}, false) AS INT)"
            if include_nan:
                produced[f"{c}_nan"] = f"CAST({quoted(c)} IS NULL AS INT)"
        return t.with_df(_with_indicators(t.df, produced))

    def _sparse(self, t, params, include_nan):
        df, codes = with_codes(t.df, params["categories"], "__onehot")
        made = {}
        for c, code in codes.items():
            n = params["sizes"][c]
            index = F.when(qcol(c).isNull(), F.lit(n)).otherwise(code) if include_nan else code
            md = {**meta(LType.NOMINAL, params["categories"][c]), "onehot_of": c, "include_nan": include_nan}
            made[f"{c}_onehot"] = F.struct(F.lit(n + include_nan).alias("size"), index.cast("int").alias("index")).alias(f"{c}_onehot", metadata=md)
        names = t.df.columns
        exprs = [made[n] if n in made else qcol(n) for n in names] + [e for n, e in made.items() if n not in names]
        return t.with_df(df.select(*exprs))


def literal(v: str) -> str:
    """A SQL string literal."""
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_indicators(df, produced: dict[str, str]):
    """``df`` with 0/1 Nominal columns given as SQL, appended or in place of those of the same name.

    As SQL text and one schema, so that wide encodings cost a call in all, not several a column.
    """
    names = df.columns
    order = names + [n for n in produced if n not in names]
    out = df.selectExpr(*[f"{produced[n]} AS {quoted(n)}" if n in produced else quoted(n) for n in order])
    tag = meta(LType.NOMINAL, [0, 1])
    fields = [T.StructField(f.name, f.dataType, f.nullable, tag if f.name in produced else f.metadata) for f in out.schema.fields]
    return out.to(T.StructType(fields)) if len(set(order)) == len(order) else out


def expand_onehot(x, column: str, values=None):
    """0/1 columns ``<col>_<value>`` for the given categories (default: all) of a sparse one-hot column, appended."""
    t = Table.of(x)
    f = field_of(t.df, column)
    of = (f.metadata or {}).get("onehot_of")
    if of is None:
        raise SchemaError(f"{column} is not a sparse one-hot column")
    cats = category_source(f)
    if isinstance(cats, dict):
        table = open_table(t.df.sparkSession, cats)
        rows = table if values is None else table.where(F.col("v").isin(list(values)))
        place = {r["v"]: r["code"] for r in rows.collect()}  # columns are made of them
    else:
        place = {v: i for i, v in enumerate(cats)}
    wanted = sorted(place, key=place.get) if values is None else list(values)
    unknown = [v for v in wanted if v not in place]
    if unknown:
        raise SchemaError(f"{column} has no category {unknown[0]!r}")
    index = f"{quoted(column)}.`index`"
    produced = {f"{of}_{v}": f"CAST(coalesce({index} = {place[v]}, false) AS INT)" for v in wanted}
    if f.metadata.get("include_nan") and values is None:
        produced[f"{of}_nan"] = f"CAST(coalesce({index} = {quoted(column)}.`size` - 1, false) AS INT)"
    out = t.with_df(_with_indicators(t.df, produced))
    return out if isinstance(x, Table) else out.to_df()


@register
class CategoryCodes(Step):
    """C4: category -> position in the category list, missing/unknown -> NULL.
    Columns without a list use their sorted distinct values. Short lists are
    looked up in place, long ones by a join with a table of (value, code)."""
    key = "category_codes"
    accepts = frozenset({LType.ORDINAL, LType.NOMINAL, LType.STRING})

    def check(self):
        if not self.options.get("attributes"):
            yield ("no_columns", "no column selected")

    def input_columns(self):
        return list(self.options["attributes"])

    @property
    def streaming(self):  # type: ignore[override]
        return "fit"

    def _fit(self, t):
        return {"categories": {c: learned_categories(t, c) for c in self.options["attributes"]}}

    def _transform(self, t, params):
        df, codes = with_codes(t.df, params["categories"], "__code")
        return t.with_df(df.select(*[typed(codes[f], f, LType.NUMERIC) if f in codes else qcol(f) for f in t.df.columns]))


@register
class EpochMillis(Step):
    """Timestamp -> milliseconds since 1970-01-01 as a double, fraction
    kept (for time axes)."""
    key = "epoch_millis"
    accepts = frozenset({LType.DATETIME})

    def check(self):
        if not self.options.get("attributes"):
            yield ("no_columns", "no column selected")

    def input_columns(self):
        return list(self.options["attributes"])

    def _transform(self, t, params):
        sel = set(self.options["attributes"])
        exprs = [typed(epoch_micros(qcol(f.name), f.dataType) / 1000.0, f.name, LType.NUMERIC)
                 if f.name in sel else qcol(f.name) for f in t.df.schema.fields]
        return t.with_df(t.df.select(*exprs))
