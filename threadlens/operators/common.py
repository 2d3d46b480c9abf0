"""Small shared building blocks for operators."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes a lookup table may have to be broadcast; it is held whole on every executor.
BROADCAST_MAX_BYTES = 16 << 20


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row.

    ``one_row`` must come from a global ``agg`` (exactly one row, so its size
    is fixed); it is broadcast and joined on a constant key, which keeps the
    big side in place without a shuffle.
    """
    k = "__one"
    return (df.withColumn(k, F.lit(1))
            .join(F.broadcast(one_row.withColumn(k, F.lit(1))), k, "inner")
            .drop(k))


def broadcast_if_small(table: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``table`` only after measuring its bytes (texts by length, 64 a row besides).

    Above ``max_bytes`` the table is returned unchanged and the planner chooses the
    join; results are the same either way.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in table.dtypes if t == "string"]
    size = table.agg(F.coalesce(F.sum(sum(texts, F.lit(64)).cast("long")), F.lit(0))).first()[0]
    return F.broadcast(table) if size <= max_bytes else table


def number_rows(df: DataFrame, *order, name: str = "n") -> DataFrame:
    """Add 0-based places in a total order without one task seeing all rows: rows are dealt by
    range, numbered inside each range, and shifted by the sizes of the ranges before."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    # One row per range; the window below is over ranges, not rows.
    shift = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (ranged.withColumn("_inside", inside).join(shift, "_part")
                  .withColumn(name, F.col("_shift") + F.col("_inside")).drop("_part", "_inside", "_shift"))


def label_share_aggs(label: str, labels, prefix: str, null_counts: bool) -> list:
    """Share of each label value.

    ``null_counts=True``: denominator = all rows (pandas ``(s == x).mean()``).
    ``null_counts=False``: denominator = non-null labels (``value_counts(normalize=True)``),
    0 when a group has no labels.
    """
    out = []
    short = {"positive": "pos", "neutral": "neu", "negative": "neg"}
    for v in labels:
        hit = F.sum(F.when(F.col(label) == v, 1).otherwise(0))
        den = F.count(F.lit(1)) if null_counts else F.count(label)
        share = F.when(den > 0, hit / den).otherwise(F.lit(0.0))
        out.append(share.alias(f"{prefix}_{short.get(v, v)}_pct"))
    return out


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage for a frame that several later passes read.

    Rows go as a compressed Parquet table to a fresh folder below ``spark.checkpoint.dir``
    (shared storage on a cluster), so a lost executor does not force the whole upstream
    text pipeline to be recomputed, and later passes read only the columns they use. A
    checkpoint holds the same rows uncompressed, tokens at several times their bytes.
    """
    from ..sources.io import scratch_path
    spark = df.sparkSession
    path = scratch_path(spark, "kept")
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table that :func:`materialize` wrote for ``df``; nothing that is still to run may read it."""
    from ..sources.io import drop_scratch
    path = getattr(df, "_kept", None)
    if path:
        drop_scratch(df.sparkSession, path)
        df._kept = None


def pinned(df: DataFrame) -> DataFrame:
    """:func:`materialize` as a reliable checkpoint, which keeps how the rows are dealt out."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark):
    """Shuffle files of a query inside are deleted when it ends, not when the driver next collects its garbage: for
    runs of many passes that each shuffle much. Their frames are written, and read from there."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
