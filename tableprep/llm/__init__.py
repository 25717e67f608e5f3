"""Operators of a training-data pipeline: mixing, scoring, near-duplicate search,
decontamination, filters, chat formatting, secret scans and sharding.

Nothing outside this package imports it. ``queries.py`` registers one query
per operator; the operators themselves are general functions on DataFrames.
"""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code with them, so that nothing need be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
