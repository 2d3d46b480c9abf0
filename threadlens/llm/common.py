"""Helpers shared by the llm operators: scratch folders, column guards, worker state."""

from __future__ import annotations

import sys
import types as pytypes
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Rows of one Arrow batch that are turned into Python objects at a time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder path under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage: a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder (columns stay prunable)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to collect garbage, upon which Spark deletes the shuffle files of
    finished steps; the same as ``spark.cleaner.periodicGC.interval`` does, but in time."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def pick(df: DataFrame, **roles: str) -> DataFrame:
    """Select columns by role (``role=column``); columns of other names, also ones
    that clash with an operator's own names, stay outside."""
    return df.select(*[F.col(f"`{c}`").alias(r) for r, c in roles.items()])


def spread(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Deal rows round-robin over the session's shuffle width, for CPU-bound work on
    a frame that came back in few splits."""
    n = tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n)


def worker_state(key: str, make: Callable[[], object]):
    """An object kept by a Python worker (caches, loaded vocabularies) until another operator's
    takes its place: a worker that serves several steps holds one of them at a time. Only
    ever holds things that can be rebuilt, so a lost worker loses nothing."""
    mod = sys.modules.get("_llm_worker_state")
    if mod is None:
        mod = sys.modules.setdefault("_llm_worker_state", pytypes.ModuleType("_llm_worker_state"))
    held = mod.__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        held[key] = make()
    return held[key]


def slices(batch, rows: int = SLICE_ROWS) -> Iterator:
    """Cut an Arrow batch into short slices so that few rows are Python objects at once."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def slices_by_bytes(batch, column: int, limit: int = 8 << 20) -> Iterator:
    """Cut an Arrow batch into slices whose texts have about ``limit`` bytes at most
    (one row at least), so that a batch of very long texts isn't all Python objects."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n + 64
    if start < batch.num_rows:
        yield batch.slice(start)


def chunked(items: Iterable, n: int) -> Iterator[list]:
    out: list = []
    for x in items:
        out.append(x)
        if len(out) >= n:
            yield out
            out = []
    if out:
        yield out
