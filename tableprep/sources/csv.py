"""S1 CSV load with a typing pass, S5 CSV write with Python-style layout, S6
bounded output files.

Load: the files are cut into records split by split (``csv_records``), Spark's
own CSV parser makes cells of them, all text (no ``inferSchema`` pass), the NA
tokens become NULL, then ONE aggregate over all columns decides per column: all
non-missing values numbers -> double, all booleans -> boolean, else string.
Dates stay text until ``ToTimestamp``, as in the reference.
"""

from __future__ import annotations

import codecs

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OptionError
from ..functions.pyformat import NUMBER_RE, number, py_float_str, strptime_to_spark
from ..ltypes import LType, canonicalize, ltype_of_field
from ..names import qcol, qcols
from ..table import Table
from .csv_records import OPEN, records

# fixed values: text read as missing (the pandas read_csv default NA set)
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null"]
# fixed values: text read as booleans
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

SEPARATORS = {"comma": ",", "tab": "\t", "semicolon": ";", "space": " "}


def _sep(sep: str) -> str:
    s = SEPARATORS.get(sep, sep)
    s = codecs.decode(s, "unicode_escape") if "\\" in s else s
    if len(s) != 1:
        raise OptionError([("sep", "separator must be one character")])
    return s


def _header(spark, path, sep, multiline) -> list[str]:
    """Column names: the first record of the first file."""
    # quotes inside a quoted cell are doubled; a quoted cell may hold line ends
    return (spark.read.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("inferSchema", False).csv(path).columns)


def _cells(spark, path, sep, multiline, line_end, fields) -> DataFrame:
    """The rows of the files as columns; a row that does not fit is an error, not a guess."""
    rows = records(spark, path, sep, multiline, line_end)
    wide = len(fields)
    fault = (F.when(F.col("cells") == OPEN, F.lit("read_csv: a quoted cell never ends"))
             .when(F.col("head") & (F.col("cells") != wide), F.lit(f"read_csv: the header of a file does not have {wide} cells"))
             .when(F.col("cells") > wide, F.lit("read_csv: a row has more cells than the header")))
    rows = rows.where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(~F.col("head")))
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in fields)
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "nullValue": "", "mode": "PERMISSIVE"}
    return rows.select(F.from_csv("record", ddl, options).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, sep: str = ",", columns=None,
             typed: bool = True, schema=None, multiline: bool = True, line_end: str = "\n") -> DataFrame:
    """S1. Files of any size are read in splits, whatever their quoted cells hold (see ``csv_records``).

    ``schema`` (DDL string or StructType) skips the typing pass. A row with more cells than the header (even empty
    ones), a quoted cell that never ends and a file whose header has another number of cells are errors; shorter rows
    end in missing cells and empty lines are skipped. ``multiline=False`` saves the pass that looks for line ends in
    quoted cells. ``line_end`` is the character that ends lines (a carriage return before it is dropped).
    """
    if columns is not None and not columns:
        raise OptionError([("no_columns", "no column selected")])
    sep = _sep(sep)
    if schema is not None:
        kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        df = _cells(spark, path, sep, multiline, line_end, kinds.fields)
        if columns is not None:
            df = df.select(*qcols(columns))
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        df = df.select(*[F.when(qcol(c).isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(qcol(c)).alias(c)
                         if c in strings else qcol(c) for c in df.columns])
        return canonicalize(df)
    names = _header(spark, path, sep, multiline)
    raw = _cells(spark, path, sep, multiline, line_end, [T.StructField(c, T.StringType()) for c in names])
    if columns is not None:
        raw = raw.select(*qcols(columns))
    cleaned = raw.select(*[F.when(qcol(c).isin(NA_TOKENS), F.lit(None).cast("string"))
                           .otherwise(qcol(c)).alias(c) for c in raw.columns])
    if not typed:
        return cleaned
    cols = cleaned.columns
    aggs = []
    for i, c in enumerate(cols):
        x = qcol(c)
        aggs += [F.count(x).alias(f"n{i}"),
                 F.count_if(F.trim(x).rlike(NUMBER_RE)).alias(f"d{i}"),
                 F.count_if(x.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{i}")]
    row = cleaned.agg(*aggs).collect()[0]
    exprs = []
    for i, c in enumerate(cols):
        n, d, b = row[f"n{i}"], row[f"d{i}"], row[f"b{i}"]
        x = qcol(c)
        if n == d:
            exprs.append(number(x).alias(c))
        elif n == b:
            exprs.append(x.isin(TRUE_TOKENS).alias(c))
        else:
            exprs.append(x.alias(c))
    return canonicalize(cleaned.select(*exprs))


def float_format_expr(c, fmt: str):
    """``%g`` (C semantics: 6 significant digits, zeros stripped), ``%.Ng``,
    ``%.Nf``, ``%.Ne`` or ``repr`` (Python layout)."""
    if fmt in (None, "", "repr", "%r"):
        return py_float_str(c)
    x = c.cast("double")
    special = (F.when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf"))
               .when(F.isnan(x), F.lit("nan")))
    finite = F.when(special.isNull(), x)
    if fmt.endswith("f") and fmt[1:-1].lstrip(".").isdigit() or fmt == "%f":
        n = int(fmt[1:-1].lstrip(".")) if fmt != "%f" else 6
        return F.coalesce(special, _fixed(finite, n, fmt))
    if fmt.endswith("e"):
        return F.coalesce(special, F.format_string(fmt, finite))
    if not fmt.endswith("g"):
        raise OptionError([("ffloat", f"unsupported float format {fmt}")])
    p = fmt[1:-1].lstrip(".")
    p = max(int(p) if p else 6, 1)
    x = finite
    sci = F.format_string(f"%.{p - 1}e", x)
    expo = F.substring_index(sci, "e", -1).cast("int")
    fixed_fmt = F.concat(F.lit("%."), (F.lit(p - 1) - expo).cast("string"), F.lit("f"))
    fixed = _strip_zeros(F.call_function("format_string", fixed_fmt, x))
    sci_out = F.concat(_strip_zeros(F.substring_index(sci, "e", 1)), F.lit("e"),
                       F.substring_index(sci, "e", -1))
    return (F.when(special.isNotNull(), special)
            .when(x.isNull(), F.lit(None).cast("string"))
            .when(x == 0, F.lit("0"))
            .when((expo >= -4) & (expo < p), fixed)
            .otherwise(sci_out))


def _fixed(x, n: int, fmt: str):
    """``%.nf`` as C prints it: the binary value itself is rounded, ties to even.

    (Spark's ``format_string`` rounds the shortest decimal form half up.) The
    scaled value is taken with its rounding error (Dekker's product), so the
    halfway case is decided exactly; values too large for a fraction are left to Spark.
    """
    size, s = F.abs(x), float(10 ** n)
    whole = F.floor(size)
    a = size - whole  # exact
    split = 134217729.0
    p = a * s
    ah = a * split - (a * split - a)
    sh = s * split - (s * split - s)
    err = ((ah * sh - p) + ah * (s - sh) + (a - ah) * sh) + (a - ah) * (s - sh)
    f = F.floor(p)
    d = p - f
    odd = (f % 2 == 1) if n else (whole % 2 == 1)
    f = f + ((d > 0.5) | ((d == 0.5) & ((err > 0) | ((err == 0) & odd)))).cast("long")
    full = f >= int(s)
    head = (whole + full.cast("long")).cast("string")
    tail = F.lpad(F.when(full, F.lit(0)).otherwise(f).cast("string"), max(n, 1), "0")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(sign, head, F.lit("."), tail) if n else F.concat(sign, head)
    return F.when(size < 2.0**53, exact).otherwise(F.format_string(fmt, x))


def _strip_zeros(s):
    """Trailing zeros of the fraction and a bare decimal point removed."""
    return F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def write_csv(x, path: str, columns=None, sep: str = ",", nan: str = "nan", ffloat: str = "%g",
              decimal: str = ".", header: bool = True, index: bool = True,
              date: str = "%Y-%m-%d %H:%M:%S", max_records_per_file: int | None = None,
              mode: str = "overwrite") -> None:
    """S5 (+ S6 with ``max_records_per_file``)."""
    t = Table.of(x)
    sep = _sep(sep)
    decimal = codecs.decode(decimal, "unicode_escape") if "\\" in decimal else decimal
    if len(decimal) != 1:
        raise OptionError([("decimal", "decimal mark must be one character")])
    df = t.to_df() if index else t.df.select(*qcols(t.columns))
    keep = list(df.columns)
    if columns is not None:  # in the order asked for, index levels first
        lead = df.columns[:len(t.index)] if index else []
        keep = [*lead, *[c for c in columns if c not in lead]]
    exprs = []
    pattern = strptime_to_spark(date)
    fields = {f.name: f for f in df.schema.fields}
    for f in (fields[c] for c in keep):
        c = qcol(f.name)
        lt = ltype_of_field(f)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            e = float_format_expr(qcol(f.name), ffloat)
            if decimal != ".":
                e = F.translate(e, ".", decimal)
        elif lt == LType.DATETIME:
            e = F.date_format(c, pattern)
        elif isinstance(f.dataType, T.BooleanType):
            e = F.when(c, F.lit("True")).when(~c, F.lit("False"))
        else:
            e = c.cast("string")
        exprs.append(e.alias(f.name))
    w = (df.select(*exprs).write.mode(mode).option("header", header).option("sep", sep)
         .option("nullValue", nan).option("emptyValue", "").option("quote", '"').option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    w.csv(path)
