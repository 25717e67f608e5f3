"""Joins J1-J9: equi-joins on one column each side, or on index levels.

* Missing keys match missing keys (null-safe ``<=>``); Catalyst still plans it
  as an equi-join (hash or sort-merge on ``coalesce(k, 0), isnull(k)``).
* Same-named keys come out as one merged column (``coalesce``), different
  names are both kept. Clashing non-key columns get the suffixes.
* Key types must be equal, or all within {String, Nominal, Ordinal}.
* Physical strategy is Spark's (AQE: broadcast when small by statistics,
  skew-join splitting of hot keys). ``hint='broadcast'`` is honoured only
  after a bounded count proves the side has at most ``max_broadcast_rows``
  rows; otherwise the plan stays a shuffled join.
* AQE cannot split the skewed partitions of a full outer join, so there hot keys
  are looked for by default (``skew='found'``): one pass over both sides' keys
  feeds a mergeable sketch of the most frequent key hashes; keys that outgrow
  two average shuffle partitions are counted exactly and split off as below. Sides
  of together less than a megabyte are joined as they are.
* ``skew='auto'`` or a list of hot key values splits hot keys off explicitly:
  keys with at least ``skew_min_rows`` rows on either side (one grouped count
  over both sides' keys; NULL is a key like any other) are joined by a salted
  INNER join -- per key the side with more rows is spread over buckets by a
  hash of the row (at least ``salt_buckets``, about ``rows_per_salt`` rows
  each), the other side's rows copied once per bucket -- while hot rows whose
  key has no partner come back through anti joins. All other keys take the
  plain shuffled join. No row is dropped or capped.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import OptionError
from ..ltypes import CATEGORICAL, STRINGLIKE, LType, category_source, field_of, ltype_of_field, typed
from ..names import qcol, qcols, quoted
from ..session import shuffle_partitions
from ..step import Step, register
from ..table import Table, ix

HOW = {"left": "left", "right": "right", "inner": "inner", "outer": "full", "full": "full"}


def compatible(a: LType, b: LType) -> bool:
    return a == b or (a in STRINGLIKE and b in STRINGLIKE)


BROADCAST_BYTES = 64 << 20


def bounded_broadcast(df, max_rows: int, max_bytes: int = BROADCAST_BYTES):
    """``broadcast(df)`` if it provably has at most ``max_rows`` rows of together at
    most ``max_bytes`` (one job reading at most ``max_rows + 1`` rows), else ``df`` unchanged."""
    wide = [F.coalesce(F.octet_length(qcol(f.name).cast("string")), F.lit(0)) for f in df.schema.fields]
    row = df.limit(max_rows + 1).select(sum(wide, F.lit(8 * len(wide))).alias("b")).agg(F.count("b"), F.sum("b")).first()
    return F.broadcast(df) if row[0] <= max_rows and (row[1] or 0) <= max_bytes else df


def _hot_keys(L, R, lkeys, rkeys, min_rows):
    """Keys with at least ``min_rows`` rows on either side, as (key..., rows left, rows right):
    ONE grouped count over both sides' keys (map-side combined). There are at
    most rows / ``min_rows`` of them."""
    names = [f"__k{i}" for i in range(len(lkeys))]
    both = (L.select(*[qcol(k).alias(n) for k, n in zip(lkeys, names)], F.lit(0).alias("__side"))
            .unionByName(R.select(*[qcol(k).alias(n) for k, n in zip(rkeys, names)], F.lit(1).alias("__side"))))
    rows = (both.groupBy(*names).agg(F.count_if(F.col("__side") == 0).alias("__nl"),
                                     F.count_if(F.col("__side") == 1).alias("__nr"))
            .where((F.col("__nl") >= min_rows) | (F.col("__nr") >= min_rows)).collect())
    return [(tuple(r[n] for n in names), r["__nl"], r["__nr"]) for r in rows]


#: Hot keys the sketch can return, and key hashes it tracks (its error: about 3.5 rows in so many).
SKETCH_KEYS, SKETCH_ITEMS = 200, 20_000
#: Sides of together fewer bytes (by Spark's estimate) are joined without a look at their keys.
SMALL_BYTES = 1 << 20


def _key_hash(keys):
    return F.xxhash64(*[x for k in keys for x in (qcol(k), qcol(k).isNull())])


def _estimated_bytes(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def found_hot_keys(L, R, lkeys, rkeys):
    """Keys with more rows on one side than two average shuffle partitions of both, as (key..., rows left, rows right),
    and the rows of such an average partition."""
    if _estimated_bytes(L) + _estimated_bytes(R) < SMALL_BYTES:
        return [], 1
    sides = [df.select(_key_hash(keys).alias("h"), F.lit(i).alias("side")) for i, (df, keys) in enumerate(((L, lkeys), (R, rkeys)))]
    top = F.expr(f"approx_top_k(h, {SKETCH_KEYS}, {SKETCH_ITEMS})")
    rows = sides[0].unionByName(sides[1]).groupBy("side").agg(F.count(F.lit(1)).alias("n"), top.alias("top")).collect()
    average = max(1, sum(r["n"] for r in rows) // shuffle_partitions(L.sparkSession))
    seen = sorted({x["item"] for r in rows for x in r["top"] if x["count"] > 2 * average})
    if not seen:
        return [], average
    few = [df.where(_key_hash(keys).isin(seen)) for df, keys in ((L, lkeys), (R, rkeys))]
    return _hot_keys(*few, lkeys, rkeys, 2 * average), average


def skew_join(L, R, lkeys, rkeys, how, o):
    """Equi-join (null-safe) of L and R on lkeys/rkeys with hot keys split off.
    ``how`` in inner/left/right/full. Returns L columns + R columns."""
    def cond_of(a, b, ak, bk):
        c = None
        for x, y in zip(ak, bk):
            t_ = a[quoted(x)].eqNullSafe(b[quoted(y)])
            c = t_ if c is None else c & t_
        return c

    skew = o.get("skew", "found" if how == "full" and not (L.isStreaming or R.isStreaming) else None)
    spark = L.sparkSession
    plain = lambda: L.join(R, cond_of(L, R, lkeys, rkeys), how)
    if not skew:
        return plain()
    S = int(o.get("salt_buckets", 64))
    per_bucket = int(o.get("rows_per_salt", 2_000_000))
    if skew == "found":
        hot, average = found_hot_keys(L, R, lkeys, rkeys)
        # pieces well below an average partition, so that pieces which meet in one stay near it
        S, per_bucket = 2, min(per_bucket, max(1, average // 8))
    elif skew == "auto":
        hot = _hot_keys(L, R, lkeys, rkeys, int(o.get("skew_min_rows", 5_000_000)))
    else:
        hot = [(tuple(k) if isinstance(k, (list, tuple)) else (k,), 1, 0) for k in skew]
    if not hot:
        return plain()
    # per key: which side is spread over how many buckets (about ``rows_per_salt`` rows
    # each); the other side's rows of that key, the fewer, are copied to each
    rows = [(*k, nl >= nr, max(S, -(-max(nl, nr) // per_bucket))) for k, nl, nr in sorted(hot, key=str)]
    hcols = [f"__h{i}" for i in range(len(lkeys))]
    kschema = T.StructType([T.StructField(h, L.schema[k].dataType) for h, k in zip(hcols, lkeys)]
                           + [T.StructField("__spread_l", T.BooleanType()), T.StructField("__buckets", T.LongType())])
    H = spark.createDataFrame(rows, kschema)
    if len(rows) <= 100_000:
        H = F.broadcast(H)
    Lh = L.join(H, cond_of(L, H, lkeys, hcols), "inner")
    Ln = L.join(H, cond_of(L, H, lkeys, hcols), "left_anti")
    Rh = R.join(H, cond_of(R, H, rkeys, hcols), "inner")
    Rn = R.join(H, cond_of(R, H, rkeys, hcols), "left_anti")
    parts = [Ln.join(Rn, cond_of(Ln, Rn, lkeys, rkeys), how)]

    def salted(side, columns, spread):
        # the salt is a hash of the row, so a task that runs again salts alike
        one = F.array(F.pmod(F.xxhash64(*qcols(columns)), qcol("__buckets")))
        return side.withColumn("__salt", F.explode(F.when(spread, one).otherwise(
            F.sequence(F.lit(0).cast("long"), qcol("__buckets") - 1))))
    ls, rs = salted(Lh, L.columns, qcol("__spread_l")), salted(Rh, R.columns, ~qcol("__spread_l"))
    # hot keys with rows on both sides: salted inner join (every such row has a partner)
    inner = ls.join(rs, cond_of(ls, rs, lkeys, rkeys) & (ls["__salt"] == rs["__salt"]), "inner")
    parts.append(inner.select(*qcols(L.columns + R.columns)))
    # hot rows without partner on the other side (their key is absent there)
    if how in ("left", "full"):
        present_r = Rh.select(*hcols).distinct()
        lonely = Lh.select(*qcols(L.columns)).join(present_r, cond_of(Lh, present_r, lkeys, hcols), "left_anti")
        parts.append(lonely.select(*qcols(L.columns), *[F.lit(None).cast(R.schema[c].dataType).alias(c) for c in R.columns]))
    if how in ("right", "full"):
        present_l = Lh.select(*hcols).distinct()
        lonely = Rh.select(*qcols(R.columns)).join(present_l, cond_of(Rh, present_l, rkeys, hcols), "left_anti")
        parts.append(lonely.select(*[F.lit(None).cast(L.schema[c].dataType).alias(c) for c in L.columns], *qcols(R.columns)))
    out = parts[0].select(*qcols(L.columns + R.columns))
    for p_ in parts[1:]:
        out = out.unionByName(p_.select(*qcols(L.columns + R.columns)))
    return out


def _key_meta(lf, rf):
    la, lb = ltype_of_field(lf), ltype_of_field(rf)
    if la == lb:
        return la, category_source(lf)
    return LType.STRING, None


@register
class Join(Step):
    """``on='columns'`` with ``left_on``/``right_on``, or ``on='index'``;
    ``how`` in left/right/inner/outer; ``suffixes=('_l', '_r')``."""
    key = "join"
    arity = 2

    def check(self):
        if self.options.get("how", "inner") not in HOW:
            yield ("how", f"how must be one of {sorted(HOW)}")
        sfx = self.options.get("suffixes", ("_l", "_r"))
        if len(sfx) != 2 or not sfx[0] or not sfx[1] or sfx[0] == sfx[1]:
            yield ("suffix", "two different non-empty suffixes are required")
        on = self.options.get("on", "columns")
        if on not in ("columns", "index"):
            yield ("on", "on must be columns or index")
        if on == "columns" and (not self.options.get("left_on") or not self.options.get("right_on")):
            yield ("not_given", "left_on and right_on are required")

    def fit(self, left, right=None):  # type: ignore[override]
        return JoinModel(self)

    def __call__(self, left, right):  # type: ignore[override]
        return self.fit(left, right).transform(left, right)


class JoinModel:
    def __init__(self, step: Join):
        self.step = step
        self.params = {}

    def report(self):
        return [(self.step.key, "option", k, str(v)) for k, v in sorted(self.step.options.items())]

    def transform(self, left, right):
        lt, rt = Table.of(left), Table.of(right)
        o = self.step.options
        out = (join_columns if o.get("on", "columns") == "columns" else join_index)(lt, rt, o)
        from ..table import like
        return like(left, out)


def _rhs(rt: Table, o):
    r = rt.df
    if o.get("hint") == "broadcast":
        r = bounded_broadcast(r, int(o.get("max_broadcast_rows", 1_000_000)))
    return r


def join_columns(lt: Table, rt: Table, o) -> Table:
    lk, rk = o["left_on"], o["right_on"]
    how = HOW[o.get("how", "inner")]
    ls, rs = o.get("suffixes", ("_l", "_r"))
    lf, rf = field_of(lt.df, lk), field_of(rt.df, rk)
    la, lb = ltype_of_field(lf), ltype_of_field(rf)
    if not compatible(la, lb):
        raise OptionError([("type", f"key types differ: {la.value} and {lb.value}")])
    lcols, rcols = lt.columns, rt.columns
    merged = lk == rk
    L = lt.df.select(*[qcol(c).alias("l__" + c) for c in lcols])
    R = _rhs(Table(rt.df.select(*[qcol(c).alias("r__" + c) for c in rcols])), o)
    if la in STRINGLIKE and la != lb:
        L = L.withColumn("l__" + lk, qcol("l__" + lk).cast("string"))
        R = R.withColumn("r__" + rk, qcol("r__" + rk).cast("string"))
    j = skew_join(L, R, ["l__" + lk], ["r__" + rk], how, o)
    lset = set(lcols) - ({lk} if merged else set())
    rset = set(rcols) - ({rk} if merged else set())
    clash = lset & rset
    exprs = []
    for c in lcols:
        if merged and c == lk:
            kt, kc = _key_meta(lf, rf)
            if how == "inner" or how == "left":
                e = qcol("l__" + c)
            elif how == "right":
                e = qcol("r__" + c)
            else:
                e = F.coalesce(qcol("l__" + c), qcol("r__" + c))
            exprs.append(typed(e, c, kt, kc) if kt in CATEGORICAL else
                         e.alias(c, metadata=lf.metadata or {}))
        else:
            name = c + ls if c in clash else c
            exprs.append(qcol("l__" + c).alias(name, metadata=field_of(lt.df, c).metadata or {}))
    for c in rcols:
        if merged and c == rk:
            continue
        name = c + rs if c in clash else c
        exprs.append(qcol("r__" + c).alias(name, metadata=field_of(rt.df, c).metadata or {}))
    return Table(j.select(*exprs), ())


def join_index(lt: Table, rt: Table, o) -> Table:
    how = HOW[o.get("how", "inner")]
    ls, rs = o.get("suffixes", ("_l", "_r"))
    if not lt.index or not rt.index:
        raise OptionError([("index", "both tables need an index")])
    single = len(lt.index) == 1 and len(rt.index) == 1
    if single:
        pairs = [(lt.index[0], rt.index[0])]
    else:
        common = [n for n in lt.index if n in rt.index]
        if not common:
            raise OptionError([("index", "no common index level")])
        pairs = [(n, n) for n in common]
    for a, b in pairs:
        fa, fb = field_of(lt.df, ix(a)), field_of(rt.df, ix(b))
        ta, tb = ltype_of_field(fa), ltype_of_field(fb)
        if not compatible(ta, tb):
            raise OptionError([("type", f"index level types differ: {ta.value} and {tb.value}")])
    L = lt.df.select(*[qcol(c).alias("l__" + c) for c in lt.df.columns])
    R = _rhs(Table(rt.df.select(*[qcol(c).alias("r__" + c) for c in rt.df.columns])), o)
    for a, b in pairs:
        ta = ltype_of_field(field_of(lt.df, ix(a)))
        tb = ltype_of_field(field_of(rt.df, ix(b)))
        if ta != tb:
            L = L.withColumn("l__" + ix(a), qcol("l__" + ix(a)).cast("string"))
            R = R.withColumn("r__" + ix(b), qcol("r__" + ix(b)).cast("string"))
    j = skew_join(L, R, ["l__" + ix(a) for a, _ in pairs], ["r__" + ix(b) for _, b in pairs], how, o)

    def pick(a, b):
        if how in ("inner", "left"):
            return qcol("l__" + ix(a))
        if how == "right":
            return qcol("r__" + ix(b))
        return F.coalesce(qcol("l__" + ix(a)), qcol("r__" + ix(b)))

    index, exprs = [], []
    for a, b in pairs:
        name = a if a == b else "index"
        fa, fb = field_of(lt.df, ix(a)), field_of(rt.df, ix(b))
        kt, kc = _key_meta(fa, fb)
        e = pick(a, b)
        exprs.append(typed(e, ix(name), kt, kc) if kt in CATEGORICAL else
                     e.alias(ix(name), metadata=fa.metadata or {}))
        index.append(name)
    paired_l = {a for a, _ in pairs}
    paired_r = {b for _, b in pairs}
    for n in lt.index:
        if n not in paired_l:
            exprs.append(qcol("l__" + ix(n)).alias(ix(n), metadata=field_of(lt.df, ix(n)).metadata or {}))
            index.append(n)
    for n in rt.index:
        if n not in paired_r and n not in index:
            exprs.append(qcol("r__" + ix(n)).alias(ix(n), metadata=field_of(rt.df, ix(n)).metadata or {}))
            index.append(n)
    clash = set(lt.columns) & set(rt.columns)
    for c in lt.columns:
        exprs.append(qcol("l__" + c).alias(c + ls if c in clash else c,
                                            metadata=field_of(lt.df, c).metadata or {}))
    for c in rt.columns:
        exprs.append(qcol("r__" + c).alias(c + rs if c in clash else c,
                                            metadata=field_of(rt.df, c).metadata or {}))
    return Table(j.select(*exprs), tuple(index))
