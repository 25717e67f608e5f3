"""Sharding by a hypergeometric communication matrix (operator 10).

A uniform random shuffle into shards of exact size, without sorting the corpus
globally: (1) every input partition is put in random order in place; (2) the
matrix of rows sent from each partition to each shard is drawn exactly as a
uniform shuffle would give it (rows sum to the partitions, columns to the
shards); (3) one exchange moves rows to shards; (4) each shard is put in random
order again. Shard sizes are fixed beforehand, at most one row apart.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_step, fresh, hold, parts_for, q, read, small, stored

SHARDS = 16
SEED = 20
LAW = "rows"
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Exact draw: how many of ``n`` rows taken from good + bad are good."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if good < 10**9 and bad < 10**9 and good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    # beyond numpy's range: inversion outward from the mode, about one standard deviation of steps
    lo, hi = max(0, n - bad), min(n, good)
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(a, b):
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    p = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u = rng.random() - p
    up = down = mode
    p_up = p_down = p
    while u > 0 and (up < hi or down > lo):
        if up < hi:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u <= 0:
                return up
        if down > lo:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u <= 0:
                return down
    return mode


def _draw(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hypergeometric draws for whole vectors; the few beyond the library's range one by one."""
    large = (good >= 10**9) | (bad >= 10**9) | (good + bad >= 10**9)
    out = np.zeros(len(n), dtype=np.int64)
    out[~large] = rng.hypergeometric(good[~large], bad[~large], n[~large])
    for i in np.flatnonzero(large).tolist():
        out[i] = _hypergeometric(rng, int(good[i]), int(bad[i]), int(n[i]))
    return out


def communication_matrix(rows, shards: int, seed: int) -> np.ndarray:
    """``len(rows) x shards`` counts with the given row sums and column sums at most one apart.

    The law of a uniform permutation, drawn down a tree: of the columns a run of partitions has, its first half takes a
    multivariate hypergeometric share and its second half the rest. All runs of a level are drawn together, so a
    million partitions take twenty levels of vector operations. (Draws are exact in double precision.)
    """
    rows = np.asarray(rows, dtype=np.int64)
    total, size = int(rows.sum()), 1 << max(0, (len(rows) - 1).bit_length())
    upto = np.concatenate([[0], np.cumsum(rows)])
    rng = np.random.default_rng(seed)
    cells = np.array([[total // shards + (j < total % shards) for j in range(shards)]], dtype=np.int64)  # a row for each run
    while size > 1:
        size //= 2
        begin = np.minimum(np.arange(len(cells)) * 2 * size, len(rows))
        n = upto[np.minimum(begin + size, len(rows))] - upto[begin]  # rows of the first halves
        first, rest = np.zeros_like(cells), cells.sum(axis=1)
        for j in range(shards - 1):
            rest = rest - cells[:, j]
            first[:, j] = _draw(rng, cells[:, j], rest, n)
            n = n - first[:, j]
        first[:, shards - 1] = n
        cells = np.stack([first, cells - first], axis=1).reshape(-1, shards)
        cells = cells[:-(-len(rows) // size)] if size < len(rows) else cells  # runs past the last partition are empty
    return cells[:len(rows)]


#: Partitions whose rows of the matrix go to Spark at once.
MATRIX_ROWS = 50_000


def _matrix_table(spark, parts: np.ndarray, sent: np.ndarray) -> DataFrame:
    """``(p, u)``: of each partition the running row counts by shard, as a table (columnar batches made on the driver, read
    by the JVM; the plan holds no numbers). Beyond MATRIX_ROWS partitions it is stored piece by piece."""
    def piece(i, j):
        flat = pa.array(sent[i:j].ravel())
        return spark.createDataFrame(pa.table({"p": pa.array(parts[i:j]), "u": pa.ListArray.from_arrays(
            pa.array(np.arange(j - i + 1, dtype=np.int32) * sent.shape[1]), flat)}))
    if len(parts) <= MATRIX_ROWS:
        return piece(0, len(parts))
    path = hold(spark)
    for i in range(0, len(parts), MATRIX_ROWS):
        piece(i, min(len(parts), i + MATRIX_ROWS)).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def shuffle_shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
                   seed: int = SEED) -> tuple[DataFrame, str, str]:
    """All rows of ``docs`` with a shard and a slot in it; returns (frame, shard column, slot column).

    Shards hold floor or ceiling of rows / shards; slots run from 0 without gaps.
    Only per-partition row counts reach the driver (one number per input
    partition), where the matrix is drawn; it goes back as a table of one row per
    partition, joined on the partition number.

    Defined results: nulls in any column are hashed as such; repeated rows are
    separate rows with their own slots (rows alike in id and text may swap
    slots); an empty table gives an empty result; added columns are renamed if
    ``docs`` has them; equal texts are not kept together (the shuffle is uniform).
    The stored table of step 1 fixes partitions and order, so a lost executor
    cannot change what later steps read.
    """
    spark = docs.sparkSession
    key, again, part, rank, shard, slot, upto, cut, s_, c_, before_ = fresh(
        docs, "shard_key", "shard_again", "shard_part", "shard_rank", "shard", "slot", "shard_upto", "shard_cut",
        "shard_of", "shard_cut_of", "shard_before")
    ident = F.xxhash64(q(doc_id), q(text))
    # blocks are the input's partitions, but for inputs split into very small ones
    local = (docs.coalesce(parts_for(docs.count())).withColumns({key: F.xxhash64(F.lit(seed), q(doc_id), ident),
                               again: F.xxhash64(F.lit(seed + 1), q(doc_id), ident).bitwiseAND(F.lit((1 << 60) - 1))})
             .sortWithinPartitions(q(key), q(again), q(doc_id))
             .withColumn(part, F.monotonically_increasing_id()))
    local = stored(local.withColumns({rank: q(part).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
                                      part: F.shiftright(q(part), _ROW_BITS)}).drop(key))
    counts = local.groupBy(q(part)).agg(F.count("*")).toArrow()  # one number for each input partition
    parts, rows = (counts.column(i).to_numpy() for i in (0, 1))
    parts, rows = parts[np.argsort(parts)], rows[np.argsort(parts)]
    if not len(parts):
        return local.withColumns({shard: F.lit(0), slot: F.lit(0).cast("long")}).select(
            *[q(c) for c in docs.columns], q(shard), q(slot)), shard, slot
    sent = communication_matrix(rows, shards, seed).cumsum(axis=1)
    table = _matrix_table(spark, parts, sent).select(F.col("p").alias(part), F.col("u").alias(upto))
    # a row's shard: how many shards end at or before its random rank in the partition
    placed = (local.join(small(table, len(parts) * shards), part)
              .withColumn(shard, F.expr(f"cast(size(filter(`{upto}`, u -> u <= `{rank}`)) as int)"))
              .drop(upto, part, rank))
    step = cut_step(int(rows.sum()))
    placed = placed.withColumn(cut, F.expr(f"`{again}` div {step}L"))
    sizes = placed.groupBy(q(shard).alias(s_), q(cut).alias(c_)).agg(F.count("*").alias(before_))
    before = W.partitionBy(q(s_)).orderBy(q(c_)).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn(before_, F.coalesce(F.sum(q(before_)).over(before), F.lit(0)))
    inside = W.partitionBy(q(shard), q(cut)).orderBy(q(again), q(doc_id))
    out = (placed.join(small(sizes, shards * ((1 << 60) // step + 1)), (q(shard) == q(s_)) & (q(cut) == q(c_)))
           .withColumn(slot, q(before_) + F.row_number().over(inside) - 1))
    return out.select(*[q(c) for c in docs.columns], q(shard), q(slot)), shard, slot


def op10_shard(spark, sf_dir):
    out, shard, slot = shuffle_shards(read(spark, sf_dir, "documents"))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return out.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit(LAW).alias("law"), q(shard).alias("shard"),
                      q(slot).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
