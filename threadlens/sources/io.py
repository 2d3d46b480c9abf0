"""Sources and sinks (A1-A4).

Stages exchange Parquet; CSV is supported with an explicit schema and the
quoting rules multi-line comment bodies need. Every scratch location is a
child of the shared ``spark.checkpoint.dir`` (never a machine-local temp
folder), so a job can be resumed or retried from any executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

# Raw posts x comments schema (one row per comment).
RAW_SCHEMA = T.StructType([
    T.StructField("subreddit", T.StringType()),
    T.StructField("post_id", T.StringType()),
    T.StructField("post_created_utc", T.DoubleType()),
    T.StructField("post_title", T.StringType()),
    T.StructField("post_body", T.StringType()),
    T.StructField("post_score", T.LongType()),
    T.StructField("post_url", T.StringType()),
    T.StructField("comment_id", T.StringType()),
    T.StructField("comment_body", T.StringType()),
    T.StructField("comment_score", T.LongType()),
    T.StructField("comment_created_utc", T.DoubleType()),
])

# NULL is written as \N and an empty text as "", so both come back as they were; edge
# blanks stay. A text that is itself \N is the one value CSV can't carry.
CSV_OPTIONS = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE",
               "nullValue": "\\N", "emptyValue": "", "ignoreLeadingWhiteSpace": "false",
               "ignoreTrailingWhiteSpace": "false"}
# A multi-line file is read by one task, so a written file holds this many rows at most.
CSV_FILE_ROWS = 500_000


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/threadlens-{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch table of this run that no later step reads, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A1: header row, quoted multi-line fields, doubled-quote escapes; the schema is given
    (no inference pass over the data)."""
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def malformed_rows(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """How many rows of a CSV source don't fit ``schema`` (they read as NULLs)."""
    bad = "_malformed"
    wide = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    # Without pruning every column is parsed, whichever are asked for.
    rows = (spark.read.options(**CSV_OPTIONS).option("columnNameOfCorruptRecord", bad)
            .option("columnPruning", "false").schema(wide).csv(path))
    return rows.agg(F.count(bad), F.count(schema.names[0])).first()[0]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A3: CSV with header, same quoting rules as :func:`read_csv`."""
    opts = {k: v for k, v in CSV_OPTIONS.items() if k != "mode"}
    df.write.mode(mode).options(**opts | {"emptyValue": '""'}).option("maxRecordsPerFile", CSV_FILE_ROWS).csv(path)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: ``place, column, type, n_rows, n_nonnull``. One pass over the data,
    whatever the number of columns."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"_c{i}")
                                                     for i, c in enumerate(df.columns)])
    rows = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit(t).alias("type"),
                     F.col("_n").alias("n_rows"), F.col(f"_c{i}").alias("n_nonnull"))
            for i, (c, t) in enumerate(df.dtypes)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def prefix(df: DataFrame, n: int, *order) -> DataFrame:
    """A2: the first ``n`` rows in a stated total order (a file's own order is none on a cluster)."""
    return df.orderBy(*order).limit(n)


def draw(df: DataFrame, n: int, seed: int, *key) -> DataFrame:
    """``n`` rows chosen by md5 of seed and key columns, ties by the key. The choice depends on
    the rows alone, not on their order or partitions; each task keeps ``n`` rows at most."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.orderBy(h, *key).limit(n)


def with_position(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """A Parquet source's rows with their place in file order: files by name, rows as they stand.

    A row's place in its file is known to the scan, so nothing is sorted; only the files'
    row counts are added up (one row per file). A single file needs no count at all.
    """
    df = spark.read.parquet(path)
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if len(df.inputFiles()) <= 1:
        return rows.withColumn(name, F.col("_row")).drop("_file", "_row")
    sizes = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("_file")).groupBy("_file").agg(
        F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_file", (F.sum("_n").over(Window.orderBy("_file")) - F.col("_n")).alias("_before"))
    return rows.join(before, "_file").withColumn(name, F.col("_before") + F.col("_row")).drop("_file", "_row", "_before")


def prefix_in_file_order(spark: SparkSession, path: str, n: int) -> DataFrame:
    """A2: the first ``n`` rows of a Parquet source as they stand in its files, without a sort."""
    return with_position(spark, path, "_position").where(F.col("_position") < n).drop("_position")


def positional_concat(*frames: DataFrame, position: str = "position") -> DataFrame:
    """Put the columns of frames beside each other, row by row.

    Every frame has a ``position`` column (see :func:`with_position`; row-local steps keep
    it) that holds each number from 0 once. Frames of other lengths or with a place that is
    missing, null or repeated raise ``ValueError``, and so do column names that clash. One
    aggregate per frame, one join each.
    """
    names = [c for f in frames for c in f.columns if c != position]
    if len(set(names)) < len(names):
        raise ValueError("frames to concatenate share column names")
    seen = []
    for f in frames:
        r = f.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("lo"),
                  F.max(position).alias("hi")).first()
        seen.append(r.n)
        if r.d != r.n or (r.n and (r.lo != 0 or r.hi != r.n - 1)):
            raise ValueError(f"positions are not 0 to {r.n - 1}, each once")
    if len(set(seen)) > 1:
        raise ValueError(f"frames of different lengths: {seen}")
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, position)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder of this session once its rows have been read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A4: one JSON record per row (findings, summaries)."""
    df.write.mode(mode).json(path)


def as_json(df: DataFrame, cols=None, name: str = "json") -> DataFrame:
    """A4 (column form): each row rendered as a JSON object string."""
    cols = cols or df.columns
    return df.select(F.to_json(F.struct(*cols)).alias(name))
