"""Time arithmetic that does not depend on the session time zone.

Datetime columns are ``TIMESTAMP_NTZ`` (wall-clock values, like pandas'
naive datetimes and DuckDB's ``TIMESTAMP``). Casting them to the
time-zone-aware ``TIMESTAMP`` would shift them by the session zone, so
microseconds since 1970-01-01 are taken as a plain difference of wall
clocks, and turned back the same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

US_PER_DAY = 86_400_000_000


def _epoch():
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_micros(c: Column, dtype=None) -> Column:
    """Microseconds since 1970-01-01 00:00:00 (wall clock) as a long."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("long") * F.lit(US_PER_DAY)
    return F.timestamp_diff("MICROSECOND", _epoch(), c.cast("timestamp_ntz"))


def from_epoch_micros(m: Column) -> Column:
    """Inverse of :func:`epoch_micros`, as ``TIMESTAMP_NTZ``."""
    return F.timestamp_add("MICROSECOND", m.cast("long"), _epoch())


def day_micros(c: Column, dtype=None) -> Column:
    """Microseconds since midnight of the value's own day."""
    return F.pmod(epoch_micros(c, dtype), F.lit(US_PER_DAY))
