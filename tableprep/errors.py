"""Errors raised by steps and graphs."""

from __future__ import annotations


class OptionError(ValueError):
    """Invalid options of a step; carries every problem found as (code, message)."""

    def __init__(self, errors):
        self.errors = list(errors)
        super().__init__("; ".join(f"{c}: {m}" for c, m in self.errors))

    @property
    def codes(self):
        return [c for c, _ in self.errors]


class SchemaError(ValueError):
    """A step does not fit the columns or logical types of its input."""


class GraphError(ValueError):
    """A step graph is malformed (cycle, bad edge, missing input...)."""


class StreamingError(ValueError):
    """A step that needs the whole table was given a streaming DataFrame."""
