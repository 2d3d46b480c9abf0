"""Topic distances and layout (E9): the data behind an interactive topic view.

Divergences between topics are one aggregate over terms: a term's row holds the topics that
have it, so only topics that share a term meet there, and what a topic has alone follows
from its total. The layout needs the k x k divergences only, a table of the size of the
model's topics: one row, whose two axes are found by power iteration inside a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_scalars

LN2 = math.log(2.0)
# Doublings of the power iteration: the power taken is 2 to this.
DOUBLINGS = 40


def js_divergence(phi: DataFrame) -> DataFrame:
    """``a, b, jsd`` of every two topics ``a < b`` of ``topic, term, phi`` rows (terms of weight 0 may
    be left out): the Jensen-Shannon divergence, natural logarithm.

    Over the terms of one topic alone the integrand is ``ln 2 * phi / 2``, so only terms that
    both have are paired, each term's pairs inside its own row and summed before the shuffle.
    """
    rows = phi.where("phi > 0 and topic is not null")
    own = rows.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("topic", "phi"))).alias("t"))

    def pair(x: Column, y: Column) -> Column:
        p, q = x["phi"], y["phi"]
        both = p * F.log(2 * p / (p + q)) + q * F.log(2 * q / (p + q)) - LN2 * (p + q)
        return F.struct(x["topic"].alias("a"), y["topic"].alias("b"), (both / 2).alias("c"))

    pairs = F.flatten(F.transform("t", lambda x, i: F.transform(
        F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))), lambda y: pair(x, y))))
    shared = own.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.c").alias("c"))
    total = rows.groupBy("topic").agg(F.sum("phi").alias("w"))
    # Every two topics, from one row that lists them all (k of the model).
    listed = total.agg(F.sort_array(F.collect_list(F.struct("topic", "w"))).alias("t"))
    every = F.flatten(F.transform("t", lambda x, i: F.transform(
        F.slice("t", i + 2, F.greatest(F.size("t") - i - 1, F.lit(0))),
        lambda y: F.struct(x["topic"].alias("a"), y["topic"].alias("b"), (LN2 / 2 * (x["w"] + y["w"])).alias("alone")))))
    grid = listed.select(F.explode(every).alias("p")).select("p.*")
    jsd = F.greatest(F.col("alone") + F.coalesce("c", F.lit(0.0)), F.lit(0.0))
    return grid.join(shared, ["a", "b"], "left").select("a", "b", jsd.alias("jsd"))


def largest(m):
    """``(w, v)``: the largest eigenvalue of a symmetric matrix and a unit vector of it, whose
    component of largest size is positive. Power iteration by squaring: a shift by the
    largest absolute row sum makes all eigenvalues 0 or more, and the shifted matrix to
    the power 2 ** DOUBLINGS is the projection on the vector, up to a factor."""
    import numpy as np

    power = m + np.abs(m).sum(axis=1).max() * np.eye(len(m))
    for _ in range(DOUBLINGS):
        peak = np.abs(power).max()
        if not peak:
            break
        power = (power / peak) @ (power / peak)
    v = power[np.argmax(np.linalg.norm(power, axis=1))]
    if not np.linalg.norm(v):
        return 0.0, np.zeros(len(m))
    v = v / np.linalg.norm(v)
    v = v if v.max() >= -v.min() - 1e-9 else -v
    return float(v @ m @ v), v


def principal(d):
    """``(x, y, residual)``: two principal coordinates of points with distances ``d``: the
    squared distances, centred in both directions, reduced to their two largest axes."""
    import numpy as np

    d2 = d * d
    m = (d2 - d2.mean(axis=0) - d2.mean(axis=1)[:, None] + d2.mean()) / -2.0
    axes, residual = [], 0.0
    for _ in range(2):
        w, v = largest(m)
        residual = max(residual, float(np.abs(m @ v - w * v).max()))
        axes.append(v * np.sqrt(max(w, 0.0)))
        m = m - w * np.outer(v, v)
    return *axes, residual


def layout(divergences: DataFrame) -> DataFrame:
    """``topic, x, y, residual`` from ``a, b, jsd`` rows: principal coordinates (see
    :func:`principal`; an axis without positive weight is 0). The divergences of k topics
    are gathered in one row, whose size is the model's. ``residual`` is the largest entry of
    ``B v - w v`` over both axes, for checking. A single topic has no pair and gives no row."""
    key = divergences.schema["a"].dataType
    listed = divergences.agg(F.collect_list(F.struct("a", "b", "jsd")).alias("p"))

    def work(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for pairs in pdf["p"]:
                names = sorted({p[k] for p in pairs for k in ("a", "b")})
                if not names:
                    continue
                at = {t: i for i, t in enumerate(names)}
                d = np.zeros((len(names), len(names)))
                for p in pairs:
                    d[at[p["a"]], at[p["b"]]] = d[at[p["b"]], at[p["a"]]] = p["jsd"]
                x, y, residual = principal(d)
                yield pd.DataFrame({"topic": names, "x": x, "y": y, "residual": residual})

    return listed.mapInPandas(work, f"topic {key.simpleString()}, x double, y double, residual double")


def topic_map(phi: DataFrame, sizes: DataFrame) -> DataFrame:
    """``topic, x, y, share, rank``: the layout and each topic's share of ``sizes`` (topic, n)."""
    total = sizes.agg(F.sum("n").alias("_all"))
    shares = attach_scalars(sizes, total).select("topic", (F.col("n") / F.col("_all")).alias("share"))
    place = layout(js_divergence(phi)).select("topic", "x", "y").join(shares, "topic")
    return place.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("share"), F.asc("topic"))))


def saliency(counts: DataFrame, n: int | None = None) -> DataFrame:
    """``term, freq, distinctiveness, saliency`` of ``topic, term, n`` rows: distinctiveness is the
    divergence of the topics given the term from the topics overall, saliency that times the
    term's share of all tokens. With ``n`` only that many of the most salient (ties by term)."""
    counts = counts.where("n > 0")
    total = counts.agg(F.sum("n").alias("_all"))
    topics = attach_scalars(counts.groupBy("topic").agg(F.sum("n").alias("_t")), total).select(
        "topic", (F.col("_t") / F.col("_all")).alias("p_t"))
    # k rows of the model's topics; AQE broadcasts them after measuring.
    terms = counts.join(topics, "topic").groupBy("term").agg(
        F.sum("n").alias("freq"), F.sum(F.col("n") * F.log(F.col("n") / F.col("p_t"))).alias("_s"))
    # sum n/f ln(n / (f p)) = (sum n ln(n / p)) / f - ln f
    d = F.greatest(F.col("_s") / F.col("freq") - F.log("freq"), F.lit(0.0))
    out = attach_scalars(terms.withColumn("distinctiveness", d), total).select(
        "term", "freq", "distinctiveness", (F.col("freq") / F.col("_all") * F.col("distinctiveness")).alias("saliency"))
    return out if n is None else out.orderBy(F.desc("saliency"), F.asc("term")).limit(n)
