"""Inference with given models: topic mixtures for fixed topics (E1), labels from a stored weight
table (D4). Nothing is fitted, so any published topic or linear model can be applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_scalars, broadcast_if_small

# Cells whose weights a task holds at a time (one document at least).
HELD_CELLS = 1 << 16


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def fixed_points(n, phi, starts, alpha: float, tolerance: float, steps: int):
    """``theta, moved, fit, total`` of documents whose cells (``n``, ``phi``: cells x topics) begin at ``starts``.

    All documents take a step at a time; those that no longer move leave."""
    import numpy as np

    k, docs = phi.shape[1], len(starts)
    sizes = np.diff(np.append(starts, len(n)))
    total = np.add.reduceat(n, starts)
    theta, moved = np.full((docs, k), 1.0 / k), np.full(docs, np.inf)
    live, own = np.arange(docs), np.repeat(np.arange(docs), sizes)
    w, p, first = n, np.ascontiguousarray(phi.T), starts
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(steps):
            x = np.ascontiguousarray(theta[live].T)[:, own]
            x *= p
            s = x.sum(axis=0)
            x *= np.where(s != 0, w / s, 0.0)
            new = ((np.add.reduceat(x, first, axis=1) + alpha) / (total[live] + alpha * k)).T
            moved[live] = np.abs(new - theta[live]).max(axis=1)
            theta[live] = new
            stay = ~(moved[live] < tolerance)
            if not stay.all():
                live = live[stay]
                if not len(live):
                    break
                cells = stay[own]
                sizes = sizes[stay]
                own = np.repeat(np.arange(len(live)), sizes)
                first = np.cumsum(sizes) - sizes
                w, p = w[cells], p[:, cells]
        own = np.repeat(np.arange(docs), np.diff(np.append(starts, len(n))))
        fit = np.add.reduceat(n * np.log((theta[own] * phi).sum(axis=1)), starts)
    return theta, moved, fit, total


def infer_mixtures(counts: DataFrame, phi: DataFrame, alpha: float = 0.1, tolerance: float = 1e-5,
                   steps: int = 100) -> DataFrame:
    """E1 with fixed topics: ``doc, theta, bound, converged, total`` of ``doc, term, n`` rows for ``term, phi``
    rows (``array<double>``, a weight for every topic, of equal length).

    The mixture is the maximum of ``sum n log(theta . phi) + alpha sum log theta``, found from
    equal shares by fixed-point steps until no share moves by ``tolerance`` or after ``steps``;
    ``bound`` is that sum at the last mixture, and no step lowers it. Terms without topics
    are left out; a document without any other term has no row. ``total`` is the document's
    tokens that have topics; a term may stand in several rows. One join by term, one aggregate by
    document; the search then runs over many documents' cells at once (numpy inside the task).
    """
    # A term that stands there twice gets its first weights in order.
    topics = phi.groupBy("term").agg(F.min("phi").alias("phi"))
    cells = counts.where("n > 0").join(topics, "term").groupBy("doc").agg(
        F.collect_list(F.struct(F.col("n").cast("double").alias("n"), "phi")).alias("cells"))
    find, most = fixed_points, HELD_CELLS

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            n = lists.flatten().field(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().field(1).flatten().to_numpy(zero_copy_only=False)
            at = at - at[0]
            k = len(flat) // max(len(n), 1)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
                own = slice(at[lo], at[hi])
                theta, moved, fit, total = find(n[own], flat.reshape(-1, k)[own], at[lo:hi] - at[lo], alpha, tolerance, steps)
                with np.errstate(divide="ignore", invalid="ignore"):
                    bound = fit + alpha * np.log(theta).sum(axis=1)
                ends = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(theta.ravel())),
                     pa.array(bound, mask=~np.isfinite(bound)), pa.array(moved < tolerance), pa.array(total)],
                    names=["doc", "theta", "bound", "converged", "total"])
                lo = hi

    doc = cells.schema["doc"].dataType.simpleString()
    return cells.mapInArrow(work, f"doc {doc}, theta array<double>, bound double, converged boolean, total double")


def score_with_weights(docs: DataFrame, counts: DataFrame, weights: DataFrame, bias: DataFrame, prefix: str = "bert") -> DataFrame:
    """D4 with stored weights: ``doc, {prefix}_label, {prefix}_score`` of every row of ``docs`` (doc, unique).

    ``counts`` are ``doc, term, n`` rows, ``weights`` ``term, label, weight`` rows, ``bias`` ``label, bias``
    rows, one a label. A label's logit is its bias plus the weights of the document's terms, by
    count; the score is the softmax of the best label (ties: the label's order). A document
    without a weighted term is scored by the biases. The table is broadcast only after a
    check of its bytes; the product is a join by term and an aggregate by document.
    """
    table = broadcast_if_small(weights.groupBy("term", "label").agg(F.sum("weight").alias("weight")))
    dot = counts.join(table, "term").groupBy("doc", "label").agg(F.sum(F.col("n") * F.col("weight")).alias("dot"))
    # Labels are few by nature; they come to every document as one array.
    labels = bias.agg(F.sort_array(F.collect_list(F.struct("label", "bias"))).alias("_b"))
    rows = dot.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("label", "dot"))).alias("_d"))
    every = attach_scalars(docs.select("doc").join(rows, "doc", "left"), labels)
    logits = F.transform("_b", lambda b: F.struct(
        (b["bias"] + F.coalesce(F.element_at(F.coalesce("_d", F.expr("map()").cast("map<string,double>")), b["label"]),
                                F.lit(0.0))).alias("z"), b["label"].alias("label")))
    every = every.withColumn("_z", logits).withColumn("_top", F.array_max(F.transform("_z", lambda z: z["z"])))
    best = F.element_at(F.filter("_z", lambda z: z["z"] == F.col("_top")), 1)["label"]
    total = _sum(F.transform("_z", lambda z: F.exp(z["z"] - F.col("_top"))))
    return every.select("doc", best.alias(f"{prefix}_label"), (F.lit(1.0) / total).alias(f"{prefix}_score"))
