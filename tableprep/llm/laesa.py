"""Centroid clustering with a pivot table (operator 13).

Vectors become exact integers. The distances of every vector to a few fixed
pivots are worked out once and stored beside it. In each round the centroids'
own distances to the pivots give, by the triangle inequality, a lower bound of
every vector's distance to every centroid; only centroids whose bound does not
exceed the best distance found so far get the exact integer distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import q, read, stored
from .textblock import trim

DIMENSION, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
PIVOTS = 16
#: Pivots are chosen from this many vectors, those of smallest hash (a bounded sample; it only affects speed).
PIVOT_SAMPLE = 256
#: Integer components stay below this size, so that no squared distance leaves 64 bits.
LIMIT = 1 << 27
_CHUNK = 8_192
_DIGITS = T.DecimalType(38, 0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column without nulls, all lists ``width`` long, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _whole(column: pa.Array, dimension: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose lists have ``dimension`` finite numbers, and those lists as floor(scale * x)."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dimension)
    x = column.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(np.nan)
    x = x.to_numpy(zero_copy_only=False).reshape(len(rows), dimension)
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(scale * x[good])
    if len(x) and np.abs(x).max() >= LIMIT:
        raise ValueError(f"a component is {LIMIT / scale:.0f} or more in size: distances would leave 64 bits")
    return rows[good], x.astype(np.int64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer arrays."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each row of ``x`` to each pivot."""
    out = np.empty((len(x), len(pivots)))
    for p, v in enumerate(pivots):
        out[:, p] = np.sqrt(_squared(x, v[None]).astype(np.float64))
    return out


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of the sample, each the one farthest in sum from those chosen before."""
    if not len(sample):
        return sample
    at, total = [0], np.zeros(len(sample))
    while len(at) < min(n, len(sample)):
        total += np.sqrt(_squared(sample, sample[at[-1]][None]).astype(np.float64))
        total[at] = -1
        at.append(int(total.argmax()))
    return sample[at]


def nearest(x: np.ndarray, stored_distances: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its squared distance, and how many exact distances were made."""
    of_centroids = to_pivots(centroids, pivots)
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(stored_distances[:, p, None] - of_centroids[None, :, p]), out=bound)
    # roots are rounded: a bound counts only by more than what rounding can make
    bound -= 1e-9 * (1 + stored_distances.max(axis=1, initial=0)[:, None] + of_centroids.max(initial=0))
    order = bound.argsort(axis=1, kind="stable")
    sorted_bound = np.take_along_axis(bound, order, axis=1)
    cluster = order[:, 0].copy()
    best = _squared(x, centroids[cluster])
    made, left = len(x), np.arange(len(x))
    for j in range(1, len(centroids)):
        left = left[sorted_bound[left, j] <= np.sqrt(best[left].astype(np.float64))]  # bounds rise with j
        if not len(left):
            break
        c = order[left, j]
        d = _squared(x[left], centroids[c])
        made += len(left)
        better = (d < best[left]) | (d == best[left]) & (c < cluster[left])
        at = left[better]
        best[at], cluster[at] = d[better], c[better]
    return cluster, best, made


def _kept(df: DataFrame, vec_id: str, vector: str, dimension: int, scale: int) -> DataFrame:
    """``(vec_id, v)``: the vectors that count, as integers."""
    kind = df.schema[vec_id].dataType

    def run(batches):
        for b in batches:
            rows, x = _whole(b.column(1), dimension, scale)
            if len(rows):
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * dimension)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.ListArray.from_arrays(
                    offsets, pa.array(x.astype(np.int32).ravel()))], ["vec_id", "v"])
        trim()
    return df.select(q(vec_id).alias("vec_id"), q(vector).cast("array<double>").alias("v")).mapInArrow(
        run, T.StructType([T.StructField("vec_id", kind), T.StructField("v", T.ArrayType(T.IntegerType()))]))


def _with_distances(kept: DataFrame, pivots: np.ndarray, dimension: int) -> DataFrame:
    """The pivot table: ``(vec_id, v, to_pivot)``."""
    def run(batches):
        for b in batches:
            d = to_pivots(_matrix(b.column(1), dimension).astype(np.int64), pivots)
            offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * d.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(d.ravel()))],
                                             ["vec_id", "v", "to_pivot"])
        trim()
    schema = T.StructType([*kept.schema.fields, T.StructField("to_pivot", T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(run, schema)


def _assigned(batches, centroids, pivots):
    """Of each batch in small runs: (batch, first row, integers, clusters, squared distances)."""
    for b in batches:
        x_all, d_all = _matrix(b.column(1), centroids.shape[1]), _matrix(b.column(2), len(pivots))
        for i in range(0, len(x_all), _CHUNK):
            x = x_all[i:i + _CHUNK].astype(np.int64)
            yield b, i, x, *nearest(x, d_all[i:i + _CHUNK], centroids, pivots)[:2]


def _sums(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> dict[int, list[int]]:
    """cluster -> [count, sum of each component], of one round: each task sends a row for each cluster and
    component it met, and Spark adds them up."""
    k, dimension = centroids.shape

    def run(batches):
        total = np.zeros((k, dimension + 1), dtype=object)
        for _, _, x, cluster, _ in _assigned(batches, centroids, pivots):
            part = np.zeros((k, dimension + 1), dtype=np.int64)  # _CHUNK values below LIMIT: far from 64 bits
            np.add.at(part, cluster, np.hstack([np.ones((len(x), 1), dtype=np.int64), x]))
            total += part
        c, at = np.nonzero(np.repeat(total[:, :1] > 0, dimension + 1, axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()),
                                          pa.array([int(v) for v in total[c, at]], pa.int64())], ["c", "at", "s"])
        trim()
    rows = table.mapInArrow(run, "c int, at int, s long").groupBy("c", "at").agg(F.sum(F.col("s").cast(_DIGITS)).alias("s")).collect()
    out: dict[int, list[int]] = {}
    for c, at, s in rows:  # clusters x (dimension + 1) rows
        out.setdefault(c, [0] * (dimension + 1))[at] = int(s)
    return out


def cluster_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION,
                    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, n_pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray]:
    """One row per kept vector: ``(vec_id, cluster, distance)`` and the final centroids.

    A vector is kept if it has exactly ``dimension`` finite components; component x becomes floor(scale * x).
    Centroids start as the ``clusters`` kept vectors of smallest sha256 of ``1:<vec_id>``; each round assigns every
    vector (ties: smaller number) and replaces each centroid that got any by floor(sum / count) of each component.

    Only centroids, pivots (chosen from 256 vectors of smallest hash) and one number per cluster and component reach
    the driver; a hot vector or cluster is added up inside each task first. The stored table of step one (integers and
    pivot distances) is what every round reads, so a lost executor repeats only its own tasks of that round.

    Defined results: null vectors, vectors of another length and those with a null or non-finite component are left
    out; a null id counts as an empty text in the hash; rows that share an id are vectors of their own (equal hashes go
    by the components); fewer kept vectors than ``clusters`` give as many centroids as there are; an empty table gives
    an empty result; other columns are not read. A component of 2**27 / scale or more in size is an error.
    """
    kept = _kept(vectors, vec_id, vector, dimension, scale)
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(key, "v").limit(max(PIVOT_SAMPLE, clusters)).select("v").collect()
    sample = np.array([r["v"] for r in first], dtype=np.int64).reshape(len(first), dimension)
    centroids, pivots = sample[:clusters].copy(), choose_pivots(sample, n_pivots)
    kind = T.StructType([kept.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(sample):
        return kept.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    table = stored(_with_distances(kept, pivots, dimension))
    for _ in range(rounds):
        for c, (n, *sums) in _sums(table, centroids, pivots).items():
            centroids[c] = [s // n for s in sums]

    def run(batches):
        for b, i, _, cluster, best in _assigned(batches, centroids, pivots):
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(best)), pa.array(cluster, pa.int32()), pa.array(best, pa.int64())],
                                             ["vec_id", "cluster", "distance"])
        trim()
    return stored(table.mapInArrow(run, kind)), centroids


def digest(components) -> str:
    """sha256 of components as decimal integers joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for x in components).encode()).hexdigest()


def op13_laesa(spark, sf_dir):
    out, centroids = cluster_vectors(read(spark, sf_dir, "embeddings"))
    by = out.groupBy(F.col("cluster").alias("of")).agg(F.sum(F.col("distance").cast(_DIGITS)).alias("part"))
    by = {r["of"]: int(r["part"]) for r in by.collect()}  # a row for each cluster
    of = F.element_at(F.array(*[F.lit(by.get(c, 0)).cast("long") for c in range(max(1, len(centroids)))]), F.col("cluster") + 1)
    sha = F.element_at(F.array(*[F.lit(digest(c)) for c in centroids] or [F.lit("")]), F.col("cluster") + 1)
    return out.select("vec_id", "cluster", "distance", of.alias("cluster_inertia"), F.lit(sum(by.values())).cast("long").alias("inertia"),
                      sha.alias("centroid_sha256"))


def _sql() -> str:
    """The same rounds in SQL: every distance, no pivots."""
    floor_div = "(s - ((s % n + n) % n)) // n"
    parts = [f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION})""",
             f"""c0 AS MATERIALIZED (SELECT c, v FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept)
        WHERE c < {CLUSTERS})"""]
    for i in range(ROUNDS + 1):
        parts.append(f"""d{i} AS (SELECT k.rid, k.vec_id, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
        FROM kept k, c{i} c)""")
        parts.append(f"""a{i} AS MATERIALIZED (SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(d) AS d, CAST(arg_min(c, d * {CLUSTERS} + c) AS INTEGER) AS c FROM d{i} GROUP BY rid)""")
        if i < ROUNDS:
            parts.append(f"""s{i} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, (SELECT unnest(range(1, {DIMENSION + 1})) AS i) GROUP BY c, i)""")
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN
        (SELECT c, list(CAST({floor_div} AS BIGINT) ORDER BY i) AS v FROM s{i} GROUP BY c) m ON m.c = o.c)""")
    last = ROUNDS
    return "WITH " + ",\n".join(parts) + f"""
SELECT a.vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} o ON o.c = a.c"""


OP13_SQL = _sql()
