"""Streaming label/topic shares and first-seen dedupe (M1, M2).

Both read a file source with an explicit schema, drop state behind a watermark
(M1 in update mode: a batch gives the windows it changed, closed windows leave
the state), and write through ``foreachBatch`` into a folder under the shared
checkpoint directory (the query checkpoint lives there too), so a restarted
driver or a lost executor resumes from the last committed batch. Scratch is
deleted when the result has been read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import materialize
from ..sources.io import drop_path, scratch_path


def utc_instant(col: str) -> F.Column:
    """Event time for watermarks: a wall-clock (NTZ) value read as UTC, independent
    of the session time zone; zoned timestamps pass through."""
    c = F.col(col)
    return F.make_timestamp(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                            F.date_part(F.lit("SECOND"), c), F.lit("UTC"))


def utc_wall_clock(instant: F.Column) -> F.Column:
    """Inverse of :func:`utc_instant`: the UTC wall clock of an instant, as timestamp_ntz."""
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + \
        F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_micros(instant) / F.lit(1_000_000))


def window_shares(stream: DataFrame, time_col: str, label_col: str, window: str = "1 day",
                  watermark: str = "2 days") -> DataFrame:
    """M1 (streaming plan): count per (tumbling window, label)."""
    t = stream.schema[time_col].dataType.typeName()
    s = stream.withColumn("_et", utc_instant(time_col)) if t == "timestamp_ntz" else \
        stream.withColumn("_et", F.col(time_col))
    return (s.withWatermark("_et", watermark)
            .groupBy(F.window("_et", window).alias("w"), F.col(label_col).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")))


def first_seen(stream: DataFrame, time_col: str, keys, watermark: str = "365 days") -> DataFrame:
    """M2 (streaming plan): drop repeats of ``keys`` within the watermark delay."""
    t = stream.schema[time_col].dataType.typeName()
    s = stream.withColumn("_et", utc_instant(time_col)) if t == "timestamp_ntz" else \
        stream.withColumn("_et", F.col(time_col))
    return s.withWatermark("_et", watermark).dropDuplicatesWithinWatermark(list(keys)).drop("_et")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _run_to_table(spark: SparkSession, agg: DataFrame, mode: str, name: str) -> DataFrame:
    """Drive a streaming plan over everything available and return the written rows."""
    out = scratch_path(spark, f"{name}-out")
    ckpt = scratch_path(spark, f"{name}-ckpt")

    def sink(batch: DataFrame, batch_id: int) -> None:
        # Idempotent under batch retries: each batch has a folder of its own, which a
        # retried batch overwrites.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    q = (agg.writeStream.outputMode(mode).foreachBatch(sink)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if not _exists(spark, out):  # no input arrived: no batch wrote anything
        return spark.createDataFrame([], agg.schema)
    rows = spark.read.option("mergeSchema", "false").parquet(out)
    if mode == "update":
        # A window's last batch holds its final count.
        keys = [c for c in agg.columns if c != "n"]
        rows = rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
    kept = materialize(rows.select(*agg.columns))
    drop_path(spark, out)
    drop_path(spark, ckpt)
    return kept


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet file source over a folder or a single file.

    A single file is addressed through a one-file glob: the file source takes a
    plain path as its base folder, which must be a directory.
    """
    path = path.rstrip("/")
    if path.endswith(".parquet"):
        path = path[:-1] + "[t]"
    return spark.readStream.schema(schema).parquet(path)


def stream_window_shares(spark: SparkSession, source_dir: str, schema, time_col: str, label_col: str,
                         window: str = "1 day") -> DataFrame:
    """M1 end to end: counts and within-window shares per (window, label)."""
    s = read_stream(spark, source_dir, schema)
    res = _run_to_table(spark, window_shares(s, time_col, label_col, window), "update", "m1")
    res = res.select(utc_wall_clock(F.col("w.start")).alias("window_start"), "label", "n")
    from pyspark.sql import Window
    return res.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("window_start")))


def stream_first_seen(spark: SparkSession, source_dir: str, schema, time_col: str, keys) -> DataFrame:
    """M2 end to end: one row per key combination, the first arrival kept."""
    s = read_stream(spark, source_dir, schema)
    return _run_to_table(spark, first_seen(s, time_col, keys), "append", "m2")
