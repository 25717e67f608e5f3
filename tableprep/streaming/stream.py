"""Structured Streaming use of the steps.

The reference has no streaming. Spark adds one thing for free: every
row-local step (``streaming == "yes"``) runs on a streaming DataFrame
unchanged, and every fitted step (``"fit"``) does once fitted on a batch
table; steps that need the whole table (``"no"``) raise. Sinks go through
``writeStream`` with a checkpoint under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import StreamingError
from ..session import ensure_checkpoint_dir
from ..step import Model, Step
from ..table import Table


def read_parquet_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int | None = None):
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return r.load(path)


def fit_on_batch(steps: list[Step], batch) -> list[Model]:
    """Fit a chain of one-input steps on a batch table (in order: each fit sees
    the output of the previous models)."""
    models = []
    cur = batch
    for s in steps:
        if s.streaming == "no":
            raise StreamingError(f"{s.key} cannot run on a stream")
        m = s.fit(cur)
        models.append(m)
        cur = m.transform(cur)
    return models


def apply_models(models: list[Model], stream):
    """Row-local application of fitted models to a streaming DataFrame/Table."""
    t = Table.of(stream)
    if not t.is_streaming:
        raise StreamingError("expected a streaming DataFrame")
    cur = stream
    for m in models:
        cur = m.transform(cur)
    return cur


def write_stream_table(x, name: str, checkpoint: str | None = None, trigger_once: bool = True):
    """S10 for streams: append into a managed table via ``writeStream.toTable``."""
    t = Table.of(x)
    df: DataFrame = t.df
    ckpt = checkpoint or f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stream-{name}-{uuid.uuid4().hex}"
    w = df.writeStream.option("checkpointLocation", ckpt).outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.toTable(name)
