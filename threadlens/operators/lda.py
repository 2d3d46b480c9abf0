"""The final topic model (E1): online variational Bayes (Hoffman, Blei, Bach 2010) over the whole corpus.

The steps are those of Spark's online LDA with every document in every pass. A pass sends the
k x V expected weights to the tasks, which take the variational steps of many documents at
once in numpy and give out summed statistics by term; Spark adds them up. The k x V weights
are driver state, as they are in Spark's LDA: they follow the vocabulary's df bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import drop_scratch, scratch_path
from .topic_batch import digamma, like_sizes, mixed, ratios

# Cells (document, term) whose weights a task holds at a time, and tokens counted at a time.
STEP_CELLS, HELD_TOKENS = 1 << 15, 1 << 20
# A document's mixture is found when its topics move by less than this on average.
TOLERANCE, STEPS = 1e-3, 100
# Steps of a pass at most while topics are learned: the next pass goes on where they end.
PASS_STEPS = 10


def counted(docs: DataFrame, terms, doc_col: str, tokens_col: str) -> DataFrame:
    """``doc_col, n_own, last, cells`` of every row: its tokens among ``terms`` (an Arrow array), the highest of
    their numbers (places in ``terms``) and pairs of a number and how often it stands there (ascending;
    32-bit integers in one binary value, which is written and sent at a fraction of an array's time)."""
    held = docs.sparkSession.sparkContext.broadcast(terms)
    size, most, blobs = len(terms), HELD_TOKENS, _blobs

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                before = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
                lists = batch.column(1).slice(lo, hi - lo)
                row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                found = pc.index_in(lists.flatten(), value_set=held.value)
                own = pc.is_valid(found).to_numpy(zero_copy_only=False)
                ids = pc.fill_null(found, 0).to_numpy(zero_copy_only=False).astype(np.int64)
                key, n = np.unique(row[own] * size + ids[own], return_counts=True)
                at = np.searchsorted(key // size, np.arange(hi - lo + 1))
                pairs = np.column_stack([key % size, n]).astype(np.int32)
                last = np.append(pairs[:, 0], 0)[at[1:] - 1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.bincount(key // size, weights=n, minlength=hi - lo).astype(np.int64)),
                     pa.array(last, pa.int32(), mask=at[1:] == at[:-1]), blobs(pairs, at)],
                    names=[doc_col, "n_own", "last", "cells"])
                lo = hi

    kind = docs.schema[doc_col].dataType.simpleString()
    return docs.select(doc_col, tokens_col).mapInArrow(work, f"`{doc_col}` {kind}, n_own long, last int, cells binary")


def variational(n, terms, starts, beta, alpha: float, gamma=None, steps: int = STEPS):
    """``gamma`` (documents x topics) and ``share`` (topics x cells, without the factor ``beta``) of documents
    whose cells begin at ``starts``; none is empty. ``beta`` is topics x terms; steps begin at ``gamma``."""
    import numpy as np

    k, size = len(beta), np.diff(np.append(starts, len(n)))
    gamma = np.ones((len(starts), k)) if gamma is None else gamma.copy()
    share = np.empty((k, len(n)), np.float32)
    for some in like_sizes(size, STEP_CELLS):
        place = np.arange(int(size[some].max()))
        inside = place < size[some][:, None]
        at = np.where(inside, starts[some][:, None] + place, starts[some][:, None])
        whole_b = np.ascontiguousarray(beta[:, terms[at]].transpose(1, 0, 2))
        whole_n = np.where(inside, n[at], 0).astype(np.float32)
        live, b, w = some, whole_b, whole_n
        for _ in range(steps):
            t = mixed(gamma[live], [k])
            new = alpha + t * ratios(t, b, w, [k])[1]
            stay = np.abs(new - gamma[live]).mean(axis=1) > TOLERANCE
            gamma[live] = new
            if not stay.any():
                break
            # Documents that have their mixture leave once they are many.
            if stay.mean() < 0.8:
                live, b, w = live[stay], b[stay], w[stay]
        t = mixed(gamma[some], [k])
        held = t[:, :, None] * ratios(t, whole_b, whole_n, [k])[0][0]
        share[:, at[inside]] = held.transpose(1, 0, 2)[:, inside]
    return gamma, share


def _blobs(rows, at):
    """A binary array: value i holds the bytes of ``rows[at[i]:at[i + 1]]``."""
    import numpy as np
    import pyarrow as pa

    width = rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)),
                                                            pa.py_buffer(np.ascontiguousarray(rows))])


def _cells(blobs):
    """``n, terms, starts, filled`` of a ``cells`` column; ``filled`` are the rows that are not empty."""
    import numpy as np

    at = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset:blobs.offset + len(blobs) + 1].astype(np.int64)
    data = np.frombuffer(blobs.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    pairs = np.frombuffer(data.tobytes(), np.int32).reshape(-1, 2)
    filled = np.flatnonzero(np.diff(at))
    return pairs[:, 1], pairs[:, 0], (at[filled] - at[0]) // 8, filled


class Topics:
    """A fitted model: ``weights`` (V x k, a numpy array), the variational parameters of the topics."""

    def __init__(self, spark, weights):
        self.spark, self.weights, self.k = spark, weights, weights.shape[1]

    def expected(self):
        """``exp(E[log beta])``, k x V."""
        import numpy as np

        return np.ascontiguousarray(np.exp(digamma(self.weights) - digamma(self.weights.sum(axis=0))).astype(np.float32).T)

    def phi(self) -> DataFrame:
        """``topic, term_id, phi``: term shares of every topic."""
        import numpy as np
        import pyarrow as pa

        share = self.weights / self.weights.sum(axis=0)
        ends = pa.array(np.arange(len(share) + 1, dtype=np.int32) * self.k)
        table = pa.table({"term_id": pa.array(np.arange(len(share), dtype=np.int32)),
                          "phi": pa.ListArray.from_arrays(ends, pa.array(share.ravel()))})
        return self.spark.createDataFrame(table).select(F.posexplode("phi").alias("topic", "phi"), "term_id").select(
            "topic", "term_id", "phi")

    def top_terms(self, n: int) -> DataFrame:
        """``topic, rank, term_id, weight`` of the ``n`` heaviest terms of every topic (ties by number)."""
        w = Window.partitionBy("topic").orderBy(F.desc("phi"), F.asc("term_id"))
        return self.phi().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select(
            "topic", "rank", "term_id", F.col("phi").alias("weight"))

    def mixtures(self, vectors: DataFrame, doc_col: str) -> DataFrame:
        """``doc_col, n_own, theta`` of every row; an empty document has zeros."""
        held = self.spark.sparkContext.broadcast(self.expected())
        k, find, cells_of = self.k, variational, _cells

        def work(batches):
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                n, terms, starts, filled = cells_of(batch.column(2))
                theta = np.zeros((batch.num_rows, k))
                if len(filled):
                    gamma, _ = find(n, terms, starts, held.value, 1.0 / k)
                    theta[filled] = gamma / gamma.sum(axis=1, keepdims=True)
                ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(ends, pa.array(theta.ravel()))],
                                                 names=[doc_col, "n_own", "theta"])

        kind = vectors.schema[doc_col].dataType.simpleString()
        return vectors.select(doc_col, "n_own", "cells").mapInArrow(work, f"`{doc_col}` {kind}, n_own long, theta array<double>")


def fit(vectors: DataFrame, k: int, passes: int, seed: int) -> Topics:
    """Symmetric priors 1/k, ``passes`` passes over all documents, steps of size (1 + pass) ** -0.5.

    A document's mixture stands beside its counts, so a pass begins where the last one ended and
    needs few steps; each pass's rows are written and take the place of the ones before."""
    import numpy as np

    spark = vectors.sparkSession
    size = vectors.agg(F.max("last").alias("m")).first().m
    weights = np.random.default_rng(seed).gamma(100.0, 0.01, (0 if size is None else size + 1, k))
    names, find, cells_of = [f"v{j}" for j in range(k)], variational, _cells
    rows = vectors.where("n_own > 0").select("cells", F.lit(b"").alias("gamma"))
    blobs, most = _blobs, PASS_STEPS
    schema = "cells binary, gamma binary, term_id int, " + ", ".join(f"{c} double" for c in names)
    before = None
    for step in range(1, passes + 1):
        beta = Topics(spark, weights).expected()
        held = spark.sparkContext.broadcast(beta)

        def work(batches):
            import pyarrow as pa

            stats = np.zeros(held.value.shape)
            fields = ["cells", "gamma", "term_id", *names]

            def out(columns, n):
                kinds = [pa.binary(), pa.binary(), pa.int32(), *[pa.float64()] * k]
                return pa.RecordBatch.from_arrays([columns[f] if f in columns else pa.nulls(n, t) for f, t in zip(fields, kinds)], names=fields)

            for batch in batches:
                if not batch.num_rows:
                    continue
                n, terms, starts, _ = cells_of(batch.column(0))
                old = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, k)
                gamma, share = find(n, terms, starts, held.value, 1.0 / k, old if len(old) else None, most)
                for j in range(k):
                    stats[j] += np.bincount(terms, weights=share[j], minlength=stats.shape[1])
                yield out({"cells": batch.column(0), "gamma": blobs(gamma, np.arange(len(gamma) + 1))}, batch.num_rows)
            own = np.flatnonzero(stats.any(axis=0))
            for lo in range(0, len(own), 10_000):
                at = own[lo:lo + 10_000]
                yield out({"term_id": pa.array(at.astype(np.int32)), **{c: pa.array(stats[j, at]) for j, c in enumerate(names)}}, len(at))

        path = scratch_path(spark, "lda-pass")
        rows.mapInArrow(work, schema).write.option("compression", "zstd").parquet(path)
        done = spark.read.schema(schema).parquet(path)
        rows = done.where("term_id is null").select("cells", "gamma")
        got = done.where("term_id is not null").groupBy("term_id").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        sums = np.zeros_like(weights)
        sums[got.column("term_id").to_numpy()] = np.column_stack([got.column(c).to_numpy() for c in names])
        rate = (1.0 + step) ** -0.5
        weights = (1 - rate) * weights + rate * (sums * beta.T + 1.0 / k)
        held.unpersist()
        if before:
            drop_scratch(spark, before)
        before = path
    if before:
        drop_scratch(spark, before)
    return Topics(spark, weights)
