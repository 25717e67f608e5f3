"""Python-compatible text layouts as native column expressions.

* :func:`py_float_str` prints a double the way Python's ``repr`` does
  (``3.0``, ``10000000.0``, ``1e-05``, ``1.5e+16``): shortest round-trip
  digits, plain decimals between 1e-4 and 1e16 (via an exact decimal cast),
  ``<mantissa>e<sign><2+ digits>`` outside. Known limit: for values that
  need 16 or 17 digits, Java's formatter rounds its own (inexact) digits, so
  the text may be a neighbouring string that still reads back to the same
  double but is not the one Python prints (about 4 in 10,000 random
  doubles; none among values with up to 15 digits).
* :func:`strptime_to_spark` maps a C ``strftime`` format to a Spark datetime
  pattern.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$|^\s*[+-]?([iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY])\s*$"


def number(x: Column) -> Column:
    """Text that matches ``NUMBER_RE`` as double (infinities in any case), else NULL."""
    t = F.lower(F.trim(x))
    inf = F.when(t.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(x.rlike(NUMBER_RE), F.when(t.contains("inf"), inf).otherwise(F.trim(x).try_cast("double")))


def shortest_sci(x: Column) -> Column:
    """Shortest ``d.ddde+XX`` text that parses back to ``x`` (Python's repr
    digits). Java 17 sometimes prints one digit too many, so the digits are
    searched: the first precision whose correctly rounded text round-trips."""
    cands = [F.format_string(f"%.{p - 1}e", x) for p in range(1, 18)]
    out = None
    for c in cands[:-1]:
        hit = c.cast("double") == x
        out = F.when(hit, c) if out is None else out.when(hit, c)
    return out.otherwise(cands[-1])


def _layout(sci_txt: Column, x: Column) -> Column:
    a = F.abs(x)
    mant = F.regexp_replace(F.regexp_replace(F.substring_index(sci_txt, "e", 1), r"(\.[0-9]*?)0+$", "$1"),
                            r"\.$", "")
    expo = F.substring_index(sci_txt, "e", -1).cast("int")
    # at least two exponent digits (lpad would cut a three-digit exponent)
    e_txt = F.when(F.abs(expo) < 10, F.concat(F.lit("0"), F.abs(expo).cast("string"))).otherwise(
        F.abs(expo).cast("string"))
    sci = F.concat(mant, F.lit("e"), F.when(expo < 0, F.lit("-")).otherwise(F.lit("+")), e_txt)
    plain = F.regexp_replace(F.regexp_replace(sci_txt.cast("decimal(38,21)").cast("string"), "0+$", ""),
                             r"\.$", ".0")
    return F.when((a >= 1e-4) & (a < 1e16), plain).otherwise(sci)


def _java_digit_count(x: Column) -> Column:
    """Significant digits in Spark's own text of ``x``."""
    mant = F.substring_index(x.cast("string"), "E", 1)
    d = F.regexp_replace(F.regexp_replace(F.regexp_replace(mant, r"[-.]", ""), "^0+", ""), "0+$", "")
    return F.length(d)


def fast_sci(x: Column) -> Column:
    """Spark prints doubles with Java's digit generator. When it needs at most
    15 significant digits those are the shortest round-trip digits (checked on
    2,000,000 values of many magnitudes); longer outputs may carry extra
    digits, so only they go through the search."""
    n = _java_digit_count(x)
    fmt = F.concat(F.lit("%."), (n - 1).cast("string"), F.lit("e"))
    normal = F.abs(x) >= F.lit(2.2250738585072014e-308)  # subnormals print too many digits
    return F.when((n <= 15) & normal, F.call_function("format_string", fmt, x)).otherwise(shortest_sci(x))


def py_float_str(c: Column) -> Column:
    x = c.cast("double")
    # the digits are found once per value: bound through a one-element lambda
    digits = F.transform(F.array(fast_sci(x)), lambda s: _layout(s, x))[0]
    return (F.when(x.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(x), F.lit("nan"))
            .when(F.abs(x) == F.lit(float("inf")), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
            .when(x == 0, x.cast("string"))
            .otherwise(digits))


# fixed values: C strftime directives and their Spark datetime-pattern letters
STRFTIME_TO_SPARK = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%B": "MMMM", "%b": "MMM", "%A": "EEEE", "%a": "EEE",
    "%j": "DDD", "%z": "Z", "%Z": "z", "%%": "%",
}


def strptime_to_spark(fmt: str) -> str:
    out = []
    lit = []

    def flush():
        if lit:
            text = "".join(lit).replace("'", "''")
            out.append(f"'{text}'" if re.search(r"[A-Za-z]", text) else text)
            lit.clear()

    i = 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            d = fmt[i:i + 2]
            if d not in STRFTIME_TO_SPARK:
                raise ValueError(f"unsupported directive {d}")
            flush()
            out.append(STRFTIME_TO_SPARK[d])
            i += 2
        else:
            lit.append(fmt[i])
            i += 1
    flush()
    return "".join(out)


# fixed values: formats tried in order when converting text to datetime without a format
INFER_FORMATS = [
    "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M",
    "%Y-%m-%d", "%Y/%m/%d", "%m/%d/%Y", "%d/%m/%Y", "%m-%d-%Y", "%d-%m-%Y", "%d.%m.%Y",
    "%Y%m%d", "%d %B %Y", "%B %d %Y", "%Y %B",
]
