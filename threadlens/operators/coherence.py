"""Topic coherence c_v (E3): boolean sliding windows, NPMI, indirect cosine.

Röder, Both & Hinneburg (2015). Only the topics' top words matter, so a
document is reduced to the positions of those words (a broadcast-sized
set). A word at position p lies in the windows starting at
max(0, p-w+1) .. min(p, n_windows-1); documents shorter than the window form
one window, documents without any top word are skipped. Co-occurrence is
counted per (window, topic) over pairs of that topic's top words present in
the window, so the pairs per group are bounded by topn^2 whatever the data.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EPSILON = 1e-12


# Windows of a document that are counted at a time: bounds memory for very long documents.
WINDOW_SLICE = 4_096
# Groups whose word tables a task holds at a time.
GROUPS_HELD = 64


def _window_counts_fn(groups: dict, window: int, tokens_col: str, model_of):
    """Window occurrence counts (numpy inside the task), combined per batch and group.

    A document's windows are rows of a boolean matrix over the top words it holds, made
    from prefix sums of their places; its Gram matrix has the single and the pair
    counts of all models of its group at once. Only pairs of one topic's words are given
    out. Windows themselves are counted per model, over documents with one of the
    model's words.
    """
    import numpy as np
    import pandas as pd

    class Words:
        """The top words of a group's models and what is counted of them."""

        def __init__(self, topics: dict):
            self.vocab = sorted({w for ws in topics.values() for w in ws})
            self.index = {w: i for i, w in enumerate(self.vocab)}
            self.wanted = np.eye(len(self.vocab), dtype=bool)
            models: dict = {}
            for t, ws in topics.items():
                own = [self.index[w] for w in ws]
                self.wanted[np.ix_(own, own)] = True
                models.setdefault(model_of(t), set()).update(own)
            self.masks = {m: np.isin(np.arange(len(self.vocab)), sorted(own)) for m, own in models.items()}

        def count(self, texts):
            total = np.zeros((len(self.vocab), len(self.vocab)), dtype=np.int64)
            n_windows = dict.fromkeys(self.masks, 0)
            for toks in texts:
                ids = np.array([self.index.get(t, -1) for t in (toks if toks is not None else ())], dtype=np.int64)
                place = np.flatnonzero(ids >= 0)
                if not len(place):
                    continue
                present, col = np.unique(ids[place], return_inverse=True)
                n = len(ids)
                nw = max(n - window + 1, 1)
                for m, mask in self.masks.items():
                    n_windows[m] += nw * bool(mask[present].any())
                for lo in range(0, nw, WINDOW_SLICE):
                    hi = min(nw, lo + WINDOW_SLICE)
                    end = min(hi - 1 + window, n)
                    own = (place >= lo) & (place < end)
                    c = np.zeros((end - lo + 1, len(present)), dtype=np.int32)
                    c[place[own] - lo + 1, col[own]] = 1
                    c = np.cumsum(c, axis=0, dtype=np.int32)
                    starts = np.arange(hi - lo)
                    pres = ((c[np.minimum(starts + window, end - lo)] - c[starts]) > 0).astype(np.float32)
                    total[np.ix_(present, present)] += np.rint(pres.T @ pres).astype(np.int64)
            x, y = np.nonzero(np.triu(self.wanted) & (total > 0))
            names = np.array(self.vocab, dtype=object)
            return ([*names[x], *[None] * len(self.masks)], [*names[y], *map(str, self.masks)],
                    [*total[x, y].tolist(), *n_windows.values()])

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for g, rows in pdf.groupby("g"):
                if g not in groups:
                    continue
                if g not in held:
                    if len(held) >= GROUPS_HELD:
                        held.clear()
                    held[g] = Words(groups[g])
                a, b, c = held[g].count(rows[tokens_col])
                yield pd.DataFrame({"g": g, "a": a, "b": b, "c": pd.Series(c, dtype="int64")})
    return run


def coherence_cv_per_topic(texts: DataFrame, top_words: DataFrame, tokens_col: str = "tokens",
                           window: int = 110, stride: int = 1 << 30) -> DataFrame:
    """(topic, coherence). Topics of several models may be scored in one pass: a topic's model
    is its number divided by ``stride``, and each model has its own count of windows."""
    g = F.lit(0).cast("long").alias("g")
    return grouped_coherence(texts.select(g, F.col(tokens_col)), top_words.select(g, "topic", "term"),
                             tokens_col, window, stride).drop("g")


def grouped_coherence(texts: DataFrame, top_words: DataFrame, tokens_col: str = "tokens",
                      window: int = 110, stride: int = 1 << 30) -> DataFrame:
    """(g, topic, coherence): :func:`coherence_cv_per_topic` for many groups at once; the words of a
    group's topics are looked for in that group's texts only (``g`` is a long in both)."""
    tw = top_words.select("g", "topic", "term").distinct()
    # k * topn (topic, term) rows a group: bounded by the models' size, safe to ship to tasks.
    groups: dict = {}
    for r in tw.collect():
        groups.setdefault(int(r["g"]), {}).setdefault(int(r["topic"]), []).append(r["term"])
    counts = texts.select("g", tokens_col).mapInPandas(
        _window_counts_fn(groups, window, tokens_col, lambda t: t // stride), "g long, a string, b string, c long")
    # Kept once: at most topics x words^2 rows, which the joins below read several times.
    agg = materialize(counts.groupBy("g", "a", "b").agg(F.sum("c").alias("c")))
    n_windows = agg.filter(F.col("a").isNull()).select("g", F.col("b").cast("int").alias("_m"), F.col("c").cast("double").alias("_N"))
    c1 = agg.filter(F.col("a").isNotNull() & (F.col("a") == F.col("b"))).select("g", F.col("a").alias("term"), "c")
    c2 = agg.filter(F.col("a").isNotNull() & (F.col("a") < F.col("b")))
    # All ordered pairs of each topic's words (incl. self pairs): k * topn^2 rows.
    grid = tw.select("g", "topic", F.col("term").alias("a")).join(tw.select("g", "topic", F.col("term").alias("b")), ["g", "topic"])
    g = grid.withColumn("_lo", F.least("a", "b")).withColumn("_hi", F.greatest("a", "b"))
    g = g.join(c2.select("g", F.col("a").alias("_lo"), F.col("b").alias("_hi"), F.col("c").alias("c_ab")),
               ["g", "_lo", "_hi"], "left")
    g = g.join(c1.select("g", F.col("term").alias("a"), F.col("c").alias("c_a")), ["g", "a"], "left")
    g = g.join(c1.select("g", F.col("term").alias("b"), F.col("c").alias("c_b")), ["g", "b"], "left")
    # One row per model; its topics carry its number.
    g = g.withColumn("_m", F.floor(F.col("topic") / F.lit(stride)).cast("int")).join(n_windows, ["g", "_m"], "left")
    g = g.withColumn("_N", F.coalesce("_N", F.lit(0.0)))
    c_ab = F.when(F.col("a") == F.col("b"), F.coalesce("c_a", F.lit(0))).otherwise(F.coalesce("c_ab", F.lit(0)))
    p_ab = F.coalesce(F.try_divide(c_ab, F.col("_N")), F.lit(0.0))
    p_a = F.coalesce(F.try_divide(F.col("c_a"), F.col("_N")), F.lit(0.0))
    p_b = F.coalesce(F.try_divide(F.col("c_b"), F.col("_N")), F.lit(0.0))
    # A word that stands in no window has no ratio; it counts 0, like a zero vector below.
    lr = F.log(F.try_divide(p_ab + EPSILON, p_a * p_b))
    g = g.withColumn("nlr", F.coalesce(F.try_divide(lr, -F.log(p_ab + EPSILON)), F.lit(0.0)))
    # Context vectors: v(a)[b] = nlr(a, b); v(W)[b] = sum_a nlr(a, b).
    vw = g.groupBy("g", "topic", "b").agg(F.sum("nlr").alias("vw"))
    j = g.join(vw, ["g", "topic", "b"])
    cos = j.groupBy("g", "topic", "a").agg(F.coalesce(F.try_divide(
        F.sum(F.col("nlr") * F.col("vw")),
        F.sqrt(F.sum(F.col("nlr") * F.col("nlr"))) * F.sqrt(F.sum(F.col("vw") * F.col("vw")))), F.lit(0.0)).alias("cos"))
    return cos.groupBy("g", "topic").agg(F.avg("cos").alias("coherence"))


def npmi(p_ab: float, p_a: float, p_b: float) -> float:
    """Scalar NPMI with the same epsilon (used by tests)."""
    return math.log((p_ab + EPSILON) / (p_a * p_b)) / (-math.log(p_ab + EPSILON))
