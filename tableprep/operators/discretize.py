"""Discretising: D1-D3 (K bins: uniform, quantile, k-means), D4 (user ranges),
D5-D7 (date/time ranges).

Edge conventions (kept as in the reference):
  * K bins: left-closed, last bucket closed; labels ``'0.0'``, ``'1.0'``...
  * user and date ranges: right-closed ``(a, b]``, outside -> missing.
Fits are one aggregate over all selected columns (k-means: Lloyd rounds on
the driver over an exact prefix index -- a bounded histogram plus cached
detail of the buckets holding a midpoint).
"""

from __future__ import annotations

from datetime import date, datetime, time

from pyspark.sql import functions as F

from ..functions.buckets import count_below, right_closed_label
from ..functions.prefix import PrefixIndex
from ..functions.quantiles import exact_quantiles
from ..functions.timeutil import day_micros, epoch_micros
from ..ltypes import LType, field_of, typed
from ..names import qcol
from ..step import Step, register

STRATEGIES = ("uniform", "quantile", "kmeans")


def _float_label(i: int) -> str:
    return repr(float(i))


def _place(df, produced: dict, drop_and_append: bool = False):
    """Put new columns: in place where the name exists, else at the end;
    ``drop_and_append`` always moves them to the end."""
    names = df.columns
    exprs = []
    for c in names:
        if c in produced and not drop_and_append:
            exprs.append(produced[c])
        elif c in produced:
            continue
        else:
            exprs.append(qcol(c))
    exprs += [e for n, e in produced.items() if drop_and_append or n not in names]
    return df.select(*exprs)


def merge_close_edges(edges, tol=1e-8):
    out = []
    for e in edges:
        if not out or e - out[-1] > tol:
            out.append(e)
    return out


def kmeans_edges(df, ks: dict[str, int], minmax: dict[str, tuple], counts: dict[str, int], max_iter=300):
    """1-D Lloyd rounds from uniform-bin midpoints (scikit-learn's start).

    Each round needs, per cluster, the count and sum of the values between two
    midpoints: a :class:`PrefixIndex` answers these exactly from a bounded
    histogram plus cached detail of the few buckets holding a midpoint, so
    the rounds run on the driver over summaries and a scan happens only when
    a midpoint enters a bucket not seen before. Returns [min, midpoints, max]."""
    out = {}
    for c, k in ks.items():
        lo, hi = minmax[c]
        if lo is None:
            out[c] = None
            continue
        if lo == hi:
            out[c] = [lo, hi]
            continue
        ix = PrefixIndex(df, c, counts[c], lo, hi)
        u = [lo + (hi - lo) * j / k for j in range(k + 1)]
        centers = [(u[j] + u[j + 1]) * 0.5 for j in range(k)]
        total_n, total_s = ix.below(hi)
        for _ in range(max_iter):
            mids = [(a + b) * 0.5 for a, b in zip(centers[:-1], centers[1:])]
            # nearest centre, ties to the lower one: cluster j = (mid_{j-1}, mid_j]
            cuts = [(0, 0.0)] + [ix.below(m) for m in mids] + [(total_n, total_s)]
            new = []
            for j in range(k):
                n = cuts[j + 1][0] - cuts[j][0]
                new.append((cuts[j + 1][1] - cuts[j][1]) / n if n else centers[j])  # empty: keep
            new = sorted(new)
            if new == centers:
                break
            centers = new
        out[c] = [lo] + [(a + b) * 0.5 for a, b in zip(centers[:-1], centers[1:])] + [hi]
    return out


def _lifted(v):
    """A value as compared with bin edges: raised by 1e-8 plus 1e-5 of its size,
    so that a value on an edge (up to rounding) is in the bin above it."""
    return v + (F.lit(1e-8) + F.lit(1e-5) * F.abs(v))


@register
class BinsDiscretizer(Step):
    """``attributes {col: {"bins": k}}``, ``strategy``, ``suffix``
    (None: replace in place). ``exact=False`` uses ``percentile_approx``."""
    key = "bins_discretizer"
    streaming = "fit"
    accepts = frozenset({LType.NUMERIC})

    def check(self):
        attrs = self.options.get("attributes") or {}
        if not attrs:
            yield ("no_columns", "no column selected")
        for c, o in attrs.items():
            if not o or o.get("bins") is None:
                yield ("not_given", f"{c}: number of bins not set")
            elif int(o["bins"]) < 2:
                yield ("bins", f"{c}: at least 2 bins")
        if self.options.get("strategy", "uniform") not in STRATEGIES:
            yield ("strategy", f"strategy must be one of {STRATEGIES}")
        if self.options.get("suffix") == "":
            yield ("empty_suffix", "suffix must not be empty")

    def input_columns(self):
        return list(self.options["attributes"])

    def _fit(self, t):
        attrs = self.options["attributes"]
        strategy = self.options.get("strategy", "uniform")
        cols = list(attrs)
        ks = {c: int(attrs[c]["bins"]) for c in cols}
        inner = {c: [j / ks[c] for j in range(1, ks[c])] for c in cols}
        fused = strategy == "quantile" and self.options.get("exact", True)
        row = t.df.agg(*[F.min(qcol(c).cast("double")).alias(f"mn{i}") for i, c in enumerate(cols)],
                       *[F.max(qcol(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(cols)],
                       *[F.count(qcol(c)).alias(f"n{i}") for i, c in enumerate(cols)]).collect()[0]
        minmax = {c: (row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols)}
        edges = {}
        if strategy == "uniform":
            for c in cols:
                mn, mx = minmax[c]
                edges[c] = None if mn is None else {"min": mn, "width": (mx - mn) / ks[c]}
            return {"uniform": edges, "bins": ks}
        if strategy == "quantile":
            spec = {c: [j / ks[c] for j in range(ks[c] + 1)] for c in cols}
            if fused:
                # quantiles 0 and 1 are the min and max; count, min and max of the
                # same aggregate start the exact search
                pre = {c: (row[f"n{i}"], row[f"mn{i}"], row[f"mx{i}"]) for i, c in enumerate(cols)}
                qi = exact_quantiles(t.df, inner, prefetched=pre)
                q = {c: [minmax[c][0]] + qi[c] + [minmax[c][1]] for c in cols}
            else:
                acc = int(self.options.get("accuracy", 10_000))
                r = t.df.agg(*[F.percentile_approx(qcol(c).cast("double"), spec[c], acc).alias(f"q{i}")
                               for i, c in enumerate(cols)]).collect()[0]
                q = {c: r[f"q{i}"] for i, c in enumerate(cols)}
        else:
            q = kmeans_edges(t.df, ks, minmax, {c: row[f"n{i}"] for i, c in enumerate(cols)})
        for c in cols:
            e = q[c]
            if e is None or any(v is None for v in e):
                edges[c] = None
                continue
            merged = merge_close_edges(e)
            if minmax[c][0] == minmax[c][1] or len(merged) < 2:
                edges[c] = [minmax[c][0], minmax[c][1]]  # one bin (range below the merge tolerance)
            else:
                edges[c] = merged
        return {"edges": edges}

    def _transform(self, t, params):
        attrs = self.options["attributes"]
        suffix = self.options.get("suffix")
        produced = {}
        for c in attrs:
            v = qcol(c).cast("double")
            if "uniform" in params:
                k = params["bins"][c]
                p = params["uniform"][c]
                if p is None:
                    b = F.lit(None).cast("long")
                elif p["width"] == 0:
                    b = F.when(v.isNotNull(), F.lit(0))
                else:
                    inner = [j * p["width"] + p["min"] for j in range(1, k)]
                    b = F.when(v.isNotNull(), count_below(_lifted(v), inner, strict=False))
            else:
                e = params["edges"][c]
                if e is None:
                    k, b = 1, F.lit(None).cast("long")
                else:
                    k = len(e) - 1
                    b = F.when(v.isNotNull(), count_below(_lifted(v), e[1:-1], strict=False))
            # all bins asked for are categories, also those lost to merged edges
            labels = [_float_label(j) for j in range(max(k, int(attrs[c]["bins"])))]
            out = c + suffix if suffix else c
            # k fixed labels: an array lookup per row, not a number layout
            lab = F.get(F.array(*[F.lit(x) for x in labels]), b.cast("int"))
            produced[out] = typed(lab, out, LType.ORDINAL, labels)
        return t.with_df(_place(t.df, produced))


def _check_ranges(opts_table, suffix):
    for c, o in opts_table.items():
        edges, labels = list(o.get("bins") or []), list(o.get("labels") or [])
        if len(edges) < 2:
            yield ("bins", f"{c}: at least two edges")
        if any(b <= a for a, b in zip(edges[:-1], edges[1:])):
            yield ("bins", f"{c}: edges must increase")
        if len(labels) != len(edges) - 1:
            yield ("len", f"{c}: need {len(edges) - 1} labels")
        if any(lab is None or str(lab) == "" for lab in labels):
            yield ("lab", f"{c}: empty label")
        if len(set(map(str, labels))) != len(labels):
            yield ("unique", f"{c}: labels must be unique")
    if suffix is not None and suffix == "":
        yield ("empty_suffix", "suffix must not be empty")


@register
class RangeDiscretizer(Step):
    """``table {col: {"bins": edges, "labels": labels}}, suffix='_bins'``;
    right-closed ``(a, b]``, outside -> missing; Ordinal."""
    key = "range_discretizer"
    accepts = frozenset({LType.NUMERIC})

    def check(self):
        if not self.options.get("table"):
            yield ("no_columns", "no column selected")
        yield from _check_ranges(self.options.get("table") or {}, self.options.get("suffix", "_bins"))

    def input_columns(self):
        return list(self.options["table"])

    def _transform(self, t, params):
        suffix = self.options.get("suffix", "_bins")
        produced = {}
        for c, o in self.options["table"].items():
            edges = [float(e) for e in o["bins"]]
            labels = [str(x) for x in o["labels"]]
            out = c + suffix if suffix else c
            produced[out] = typed(right_closed_label(qcol(c).cast("double"), edges, labels),
                                  out, LType.ORDINAL, labels)
        return t.with_df(_place(t.df, produced))


def _to_datetime(v) -> datetime:
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, date):
        return datetime(v.year, v.month, v.day)
    if isinstance(v, time):
        return datetime.combine(date(1900, 1, 1), v)
    s = str(v)
    for fmt in ("%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%d",
                "%H:%M:%S.%f", "%H:%M:%S", "%H:%M"):
        try:
            d = datetime.strptime(s, fmt)
            return d if "%Y" in fmt else datetime.combine(date(1900, 1, 1), d.time())
        except ValueError:
            continue
    raise ValueError(f"not a datetime: {v!r}")


def _micros(d: datetime) -> int:
    delta = d - datetime(1970, 1, 1)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000 + delta.microseconds


def _day_micros(d: datetime) -> int:
    return ((d.hour * 60 + d.minute) * 60 + d.second) * 1_000_000 + d.microsecond


@register
class DateDiscretizer(Step):
    """``selected {col: {"ranges": (edges, by_date, by_time), "labels": [...]}}``,
    ``suffix='_discr'``. By date and time: full timestamps; by date only: edges
    at midnight; by time only: time of day truncated to milliseconds."""
    key = "date_discretizer"
    accepts = frozenset({LType.DATETIME})

    def check(self):
        sel = self.options.get("selected") or {}
        if not sel:
            yield ("no_columns", "no column selected")
        table = {}
        for c, o in sel.items():
            edges, by_date, by_time = o["ranges"]
            if not by_date and not by_time:
                yield ("bins", f"{c}: choose by date and/or by time")
            try:
                conv = [self._edge(e, by_date, by_time) for e in edges]
            except ValueError as ex:
                yield ("bins", f"{c}: {ex}")
                continue
            table[c] = {"bins": conv, "labels": o.get("labels")}
        yield from _check_ranges(table, self.options.get("suffix", "_discr"))

    @staticmethod
    def _edge(e, by_date, by_time):
        d = _to_datetime(e)
        if by_date and by_time:
            return _micros(d)
        if by_date:
            return _micros(datetime(d.year, d.month, d.day))
        return (_day_micros(d) // 1000) * 1000

    def input_columns(self):
        return list(self.options["selected"])

    def _transform(self, t, params):
        suffix = self.options.get("suffix", "_discr")
        produced = {}
        for c, o in self.options["selected"].items():
            edges, by_date, by_time = o["ranges"]
            labels = [str(x) for x in o["labels"]]
            dt = field_of(t.df, c).dataType
            if by_time and not by_date:
                v = F.floor(day_micros(qcol(c), dt) / 1000) * 1000
            else:
                v = epoch_micros(qcol(c), dt)
            e = [self._edge(x, by_date, by_time) for x in edges]
            out = c + suffix if suffix else c
            produced[out] = typed(right_closed_label(v, e, labels), out, LType.ORDINAL, labels)
        return t.with_df(_place(t.df, produced, drop_and_append=True))
