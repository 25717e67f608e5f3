"""Step / Model: the operator interface.

A step is validated options plus ``DataFrame -> DataFrame``. Steps that learn
from the data are split into ``fit`` (usually one aggregate job over all
selected columns; exact quantiles and k-means take a few bounded passes;
returns a :class:`Model` holding small learned parameters) and ``Model.transform``
(row-local, lazy, also valid on a streaming DataFrame). Stateless steps fit
without touching the data.

``streaming`` declares the contract of SURVEY column S: ``"yes"`` row-local,
``"fit"`` row-local once fitted on a batch, ``"no"`` needs the whole table.
"""

from __future__ import annotations

import json
from typing import Any, ClassVar

from pyspark.sql import DataFrame

from .errors import OptionError, SchemaError, StreamingError
from .ltypes import ALL_TYPES, ltypes
from .table import Table, like

REGISTRY: dict[str, type["Step"]] = {}


def register(cls):
    REGISTRY[cls.key] = cls
    return cls


def register_step(name: str, fn, streaming: str = "yes"):
    """Extension point: a user step from a plain ``DataFrame -> DataFrame`` function."""

    cls = type(f"UserStep_{name}", (FunctionStep,), {"key": name, "fn": staticmethod(fn),
                                                     "streaming": streaming})
    REGISTRY[name] = cls
    return cls


class Step:
    key: ClassVar[str] = "step"
    streaming: ClassVar[str] = "yes"
    accepts: ClassVar[frozenset] = ALL_TYPES

    def __init__(self, **options):
        self.options = dict(options)
        errors = list(self.check())
        if errors:
            raise OptionError(errors)

    # -- option checking -------------------------------------------------
    def check(self):
        """Yield (code, message) for every problem in the options."""
        return []

    def input_columns(self) -> list[str]:
        """Columns the step reads (checked against the input schema)."""
        return []

    def check_input(self, t: Table):
        types = ltypes(t.df)
        for c in self.input_columns():
            if c not in types or c not in t.columns:
                raise SchemaError(f"{self.key}: no column {c!r}")
            if types[c] not in self.accepts:
                raise SchemaError(f"{self.key}: column {c!r} has type {types[c].value}, "
                                  f"accepted {sorted(a.value for a in self.accepts)}")

    # -- execution -------------------------------------------------------
    def fit(self, x) -> "Model":
        t = Table.of(x)
        self.check_input(t)
        if self.streaming == "no" or (self.streaming == "fit" and self.needs_fit()):
            if t.is_streaming:
                raise StreamingError(f"{self.key} needs a batch table to fit")
        return Model(self, self._fit(t))

    def needs_fit(self) -> bool:
        return self.streaming == "fit"

    def _fit(self, t: Table) -> dict:
        return {}

    # -- fits that column summaries answer (see functions.summaries) --------
    def summary_columns(self, types: dict) -> list[str] | None:
        """Numeric columns whose summaries are all that ``fit`` learns from (``types``: logical types of the input), or None."""
        return None

    def fit_from(self, summary: dict) -> dict:
        """What ``_fit`` returns, from summaries of its columns."""
        raise NotImplementedError

    def summary_after(self, summary: dict, params: dict) -> dict:
        """Summaries of the columns after the step, those that still hold."""
        return {}

    def _transform(self, t: Table, params: dict) -> Table:
        raise NotImplementedError

    def __call__(self, x):
        return self.fit(x).transform(x)

    def to_json(self) -> dict:
        return {"step": self.key, "options": self.options}

    def __repr__(self):
        return f"{type(self).__name__}({json.dumps(self.options, default=str)})"


class Model:
    """A fitted step: learned parameters + a lazy transform."""

    def __init__(self, step: Step, params: dict[str, Any]):
        self.step = step
        self.params = params

    def transform(self, x):
        t = Table.of(x)
        if t.is_streaming and self.step.streaming == "no":
            raise StreamingError(f"{self.step.key} cannot run on a streaming DataFrame")
        return like(x, self.step._transform(t, self.params))

    def report(self) -> list[tuple[str, str, str, str]]:
        """(step, kind, key, value) rows: options and learned parameters."""
        rows = [(self.step.key, "option", k, json.dumps(v, default=str, sort_keys=True))
                for k, v in sorted(self.step.options.items())]
        rows += [(self.step.key, "learned", k, json.dumps(v, default=str, sort_keys=True))
                 for k, v in sorted(self.params.items())]
        return rows


class FunctionStep(Step):
    key = "function"
    fn = None

    def _transform(self, t, params):
        out = self.fn(t.df)
        if not isinstance(out, DataFrame):
            raise TypeError("user step must return a DataFrame")
        return t.with_df(out)


def make(key: str, **options) -> Step:
    if key not in REGISTRY:
        raise OptionError([("unknown", f"no step named {key!r}")])
    return REGISTRY[key](**options)
