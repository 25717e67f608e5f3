"""Helpers shared by the operators: fresh column names, stored tables, hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def q(name: str) -> Column:
    """A column by its exact name (dots and backticks are part of the name)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with no column of ``df`` (case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def hold(spark: SparkSession) -> str:
    """A new folder under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tableprep-{uuid.uuid4().hex}"


#: Documents in a file of a stored table at least, where the input is split finer.
DOCS_PER_FILE = 4_000


def parts_for(rows: int, per_part: int = DOCS_PER_FILE) -> int:
    """Files for a stored table of so many rows."""
    return 1 + rows // per_part


def stored(df: DataFrame, parts: int | None = None) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage at a file every executor can read: later jobs see the
    same rows even if executors are lost, and nothing above is computed again.
    The files live as long as the cluster keeps its checkpoint folder; with
    ``parts`` there are at most so many (a slim table needs few).
    """
    spark = df.sparkSession
    path = hold(spark)
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of slim rows are broadcast up to this many rows, and joined by a shuffle beyond.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, marked for broadcast if it is known to have few rows (``rows``, counted beforehand)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def n_words(text: Column) -> Column:
    """Number of words of a text as long (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(seed: str, *parts: Column) -> Column:
    """60-bit hash-random key in [0, 2**60) of the given columns (null: empty text).

    MD5 of seed and parts, so that any engine can compute the same key.
    """
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


#: Range cuts of a hash-random key hold about this many rows each.
ROWS_PER_CUT = 5_000


def cut_step(n_rows: int, rows_per_cut: int = ROWS_PER_CUT) -> int:
    """Width of equal cuts of [0, 2**60) such that a cut holds about ``rows_per_cut`` rows."""
    return (1 << 60) // max(1, -(-n_rows // rows_per_cut)) + 1


def hash_share(key: Column, most: int, n: int) -> Column:
    """Condition that about ``most`` of ``n`` rows meet, a little more, chosen by a 64-bit hash ``key``.

    Bounds a sample before anything is moved: what follows sees few rows more
    than ``most`` from the whole cluster, not ``most`` rows from every task.
    """
    share = (most + 6 * most ** 0.5 + 10) / max(1, n)
    return F.lit(True) if share >= 1 else F.shiftrightunsigned(key, 1) < int(share * (1 << 63))
