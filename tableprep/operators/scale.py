"""Scaling: C1 (min-max), C2 (standard). One aggregate fits all columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..ltypes import LType, typed
from ..names import qcol
from ..step import Step, register


@register
class MinMaxScaler(Step):
    """``attributes {col: {"range": (lo, hi)}}``, lo < hi. Missing stays
    missing; a constant column maps to ``lo``."""
    key = "minmax_scaler"
    streaming = "fit"
    accepts = frozenset({LType.NUMERIC})

    def check(self):
        attrs = self.options.get("attributes") or {}
        if not attrs:
            yield ("no_columns", "no column selected")
        for c, o in attrs.items():
            lo, hi = (o or {}).get("range", (0.0, 1.0))
            if not float(lo) < float(hi):
                yield ("range", f"{c}: need lo < hi")

    def input_columns(self):
        return list(self.options["attributes"])

    def _fit(self, t):
        cols = list(self.options["attributes"])
        row = t.df.agg(*[F.min(qcol(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
                       *[F.max(qcol(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)]
                       ).collect()[0]
        return {"min": {c: row[f"a{i}"] for i, c in enumerate(cols)},
                "max": {c: row[f"b{i}"] for i, c in enumerate(cols)}}

    def summary_columns(self, types):
        return list(self.options["attributes"])

    def fit_from(self, summary):
        return {k: {c: summary[c][k] for c in self.options["attributes"]} for k in ("min", "max")}

    def summary_after(self, summary, params):
        return {c: s for c, s in summary.items() if c not in self.options["attributes"]}

    def _transform(self, t, params):
        attrs = self.options["attributes"]
        exprs = []
        for f in t.df.schema.fields:
            if f.name not in attrs:
                exprs.append(qcol(f.name))
                continue
            lo, hi = map(float, (attrs[f.name] or {}).get("range", (0.0, 1.0)))
            mn, mx = params["min"][f.name], params["max"][f.name]
            x = qcol(f.name).cast("double")
            if mn is None:
                e = F.lit(None).cast("double")
            elif mx == mn:
                e = F.when(x.isNotNull(), F.lit(lo))
            else:
                e = (x - F.lit(mn)) / F.lit(mx - mn) * F.lit(hi - lo) + F.lit(lo)
            exprs.append(typed(e, f.name, LType.NUMERIC))
        return t.with_df(t.df.select(*exprs))


@register
class StandardScaler(Step):
    """``(x - mean) / population std``; zero std -> divisor 1."""
    key = "standard_scaler"
    streaming = "fit"
    accepts = frozenset({LType.NUMERIC})

    def check(self):
        if not self.options.get("attributes"):
            yield ("no_columns", "no column selected")

    def input_columns(self):
        return list(self.options["attributes"])

    def _fit(self, t):
        cols = list(self.options["attributes"])
        row = t.df.agg(*[F.avg(qcol(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                       *[F.stddev_pop(qcol(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
                       ).collect()[0]
        return {"mean": {c: row[f"m{i}"] for i, c in enumerate(cols)},
                "std": {c: row[f"s{i}"] for i, c in enumerate(cols)}}

    def summary_columns(self, types):
        return list(self.options["attributes"])

    def fit_from(self, summary):
        return {k: {c: summary[c][k] for c in self.options["attributes"]} for k in ("mean", "std")}

    def summary_after(self, summary, params):
        return {c: s for c, s in summary.items() if c not in self.options["attributes"]}

    def _transform(self, t, params):
        cols = set(self.options["attributes"])
        exprs = []
        for f in t.df.schema.fields:
            if f.name not in cols:
                exprs.append(qcol(f.name))
                continue
            m, s = params["mean"][f.name], params["std"][f.name]
            if m is None:
                e = F.lit(None).cast("double")
            else:
                e = (qcol(f.name).cast("double") - F.lit(m)) / F.lit(s if s else 1.0)
            exprs.append(typed(e, f.name, LType.NUMERIC))
        return t.with_df(t.df.select(*exprs))
