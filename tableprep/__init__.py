"""tableprep: typed table preparation and profiling on Spark DataFrames."""

from .ltypes import LType, canonicalize  # noqa: F401
from .step import REGISTRY, Model, Step, make, register_step  # noqa: F401
from .table import Table  # noqa: F401
from .operators import (columns, compare, convert, discretize, encode, fill, join,  # noqa: F401
                        missing, order, replace, reshape, scale)
