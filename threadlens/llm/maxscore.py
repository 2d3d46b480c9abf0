"""Exact top-k search by inner product with MaxScore (operator 9).

Vectors are sparse postings by dimension ("term"): an integer weight per row. A
shard is a block of rows with, for every dimension, its least and largest weight.
For a query the dimension's score bound in a shard is ``max(q * least, q * largest)``.
Dimensions are ordered by the spread of what they can add; the last ones, whose
bounds together cannot lift a row over the current k-th score, are non-essential.
The essential postings are traversed for all rows of the shard; the others are
probed dimension by dimension for rows that are still competitive, and rows whose
partial score plus the rest of the bounds falls below the k-th best are dropped.
A shard's k best go to a merge per query.

Queries are a stated set: they are walked in blocks of bounded size, each block
sent to all shards once, so neither side is ever whole in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, written

SCALE = 256
# Query rows sent to the shards in one block (128 MB at 64 dimensions at most).
BLOCK_QUERIES = 20_000
SHARD_ROWS = 16_384
FIRST_DIMS = 8


def quantized(rows: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: ``floor(scale * x)`` as longs; rows with a null id or vector, or with
    null or non-finite components, are left out. Of rows with one id the vector that
    comes first in array order stays."""
    v = F.col("v")
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    src = (rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                       F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
               .where(F.col("vec_id").isNotNull() & v.isNotNull()).where(ok)
               .groupBy("vec_id").agg(F.min("v").alias("v")))
    return src.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(float(scale)))).alias("v"))


def matrix(lists, dims: int):
    """Rows of weights, missing dimensions as zero."""
    import numpy as np

    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def best(score, ids, k: int):
    """Positions of the k highest scores, ties to the smaller id."""
    import numpy as np

    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= kth)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))][:k]


def maxscore(q, own: int, cols, ids, low, high, k: int, first: int = FIRST_DIMS):
    """``(ids, scores)`` of the k best rows of a shard for one query.

    ``cols``: weights by dimension (one contiguous posting list each)."""
    import numpy as np

    upper = np.maximum(q * low, q * high)
    spread = upper - np.minimum(q * low, q * high)
    order = np.argsort(-spread, kind="stable")
    order = order[q[order] != 0]
    rest = np.append(np.cumsum(upper[order][::-1])[::-1], 0)  # bound of what dimensions from j on can add
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), np.int64)
    floor_ = None
    at = 0
    while at < len(order):
        step = order[at:at + first]
        if len(alive) == len(ids):
            score = score + q[step] @ cols[step]
        else:
            score = score + q[step] @ cols[np.ix_(step, alive)]
        at += len(step)
        if at >= len(order) or len(alive) <= 4 * k:
            continue
        if floor_ is None or at % (2 * first) == 0:
            # The k best partial scores, made whole, give a k-th score that the result reaches.
            top = np.argpartition(score, len(score) - k)[-k:]
            full = score[top] + q[order[at:]] @ cols[np.ix_(order[at:], alive[top])]
            floor_ = max(int(full.min()), floor_ if floor_ is not None else int(full.min()))
        keep = score + rest[at] >= floor_
        if not keep.all():
            alive, score = alive[keep], score[keep]
    pos = best(score, ids[alive], k)
    return ids[alive[pos]], score[pos]


def search(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           block_queries: int = BLOCK_QUERIES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` highest integer inner products over
    all rows but its own id, ties to the smaller id (all rows, if fewer).

    Rows and queries with null ids or vectors, or null or non-finite components, take
    no part. Repeated ids count once (smallest vector). Vectors of unequal length
    are filled with zeros. An empty table gives no rows. Weights are 64-bit integers;
    components of magnitudes whose products pass that range are outside the contract.
    """
    spark = rows.sparkSession
    base = stored(quantized(rows, id_col, vec_col))
    asked = stored(quantized(queries, id_col, vec_col))
    n_rows, dims = base.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked, q_dims = asked.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(dims, q_dims, 1)
    shards = max(1, -(-n_rows // shard_rows))
    dealt = base.repartition(max(shards, min(n_rows // 1024 + 1, spark.sparkContext.defaultParallelism)), "vec_id")
    blocks = max(1, -(-n_asked // block_queries))

    def task(sent):
        def work(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            q_ids, q_rows = sent.value
            held_ids, held, count = [], [], 0

            def shard():
                ids, w = np.concatenate(held_ids), np.concatenate(held)
                cols = np.ascontiguousarray(w.T).astype(np.float64) if abs(w).max(initial=0) < 1 << 20 \
                    and abs(q_rows).max(initial=0) < 1 << 20 else np.ascontiguousarray(w.T)
                low, high = w.min(0), w.max(0)
                for i in range(0, len(q_ids), 1024):
                    out = [(q, *maxscore(x, q, cols, ids, low, high, k))
                           for q, x in zip(q_ids[i:i + 1024], q_rows[i:i + 1024])]
                    rep = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
                    got = [np.concatenate([o[j] for o in out]).astype(np.int64) for j in (1, 2)]
                    yield pa.RecordBatch.from_arrays([pa.array(rep.astype(np.int64)), *map(pa.array, got)],
                                                     names=["query_id", "vec_id", "score"])

            for batch in batches:
                held_ids.append(batch.column(0).to_numpy())
                held.append(matrix(batch.column(1).to_pylist(), dims))
                count += batch.num_rows
                if count >= 2 * shard_rows:
                    yield from shard()
                    held_ids.clear(), held.clear()
                    count = 0
            if count and len(q_ids):
                yield from shard()
        return work

    found = None
    for b in range(blocks):
        got = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toPandas()
        import numpy as np

        sent = spark.sparkContext.broadcast((got.vec_id.to_numpy(np.int64), matrix(list(got.v), dims)))
        part = dealt.mapInArrow(task(sent), "query_id long, vec_id long, score long")
        if blocks > 1:  # the block's queries leave driver and executors before the next ones come
            part = written(part, "topk-block")
            sent.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                 .select("query_id", "rank", "vec_id", "score"))
