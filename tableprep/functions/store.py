"""Tables written once to the cluster's shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir


def stored(df: DataFrame) -> DataFrame:
    """``df`` as Parquet under ``spark.checkpoint.dir``: later reads see the same rows and compute nothing again."""
    return df.sparkSession.read.schema(df.schema).parquet(stored_at(df))


def stored_at(df: DataFrame) -> str:
    """Where ``df`` was written as Parquet under ``spark.checkpoint.dir``."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tableprep-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
