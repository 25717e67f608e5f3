"""What the tests share besides fixtures."""

from datetime import datetime

SF001 = "/root/testdata/sf0.01"
SF0001 = "/root/testdata/sf0.001"


def rows(df, *cols):
    """Column values as python lists (order of the given key column)."""
    return [tuple(r) for r in df.select(*cols).collect()]


def col(df, name, order="i"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]


def dt(s):
    return datetime.strptime(s, "%Y-%m-%d %H:%M:%S") if " " in s else datetime.strptime(s, "%Y-%m-%d")
