"""F25 p-values, c_v coherence against brute force, LDA invariants."""

import math
import random

import pytest

from threadlens.functions.stats import pearson_p_col
from threadlens.operators.coherence import EPSILON, coherence_cv_per_topic


def test_pearson_p_known_values(spark):
    def p(r, n):
        return spark.createDataFrame([(r, n)], "r double, n long").select(pearson_p_col("r", "n")).first()[0]

    assert abs(p(0.5, 10) - 0.14111328) < 1e-6
    assert abs(p(-0.3, 30) - 0.10718) < 1e-4
    assert p(1.0, 5) < 1e-12 and abs(p(0.0, 7) - 1.0) < 1e-12
    assert p(0.2, 2) is None and p(None, 9) is None
    # n = 3: the angle itself is uniform; n = 4: r itself is.
    assert abs(p(0.5, 3) - 2 / 3) < 1e-9 and abs(p(0.25, 4) - 0.75) < 1e-9
    # Large n: the normal tail.
    assert abs(p(0.00196, 1_000_002) - math.erfc(1.96 / math.sqrt(2))) < 1e-5


def brute_cv(texts, topics, window=110):
    relevant = {w for ws in topics.values() for w in ws}
    wins = []
    for t in texts:
        if not any(w in relevant for w in t):
            continue
        if len(t) <= window:
            wins.append(set(t) & relevant)
        else:
            for s in range(len(t) - window + 1):
                wins.append(set(t[s:s + window]) & relevant)
    n = len(wins)

    def p(*ws):
        return sum(1 for w in wins if all(x in w for x in ws)) / n

    def nlr(a, b):
        pab = p(a, b)
        return math.log((pab + EPSILON) / (p(a) * p(b))) / -math.log(pab + EPSILON)

    out = {}
    for t, ws in topics.items():
        vw = [sum(nlr(a, b) for a in ws) for b in ws]
        sims = []
        for a in ws:
            va = [nlr(a, b) for b in ws]
            dot = sum(x * y for x, y in zip(va, vw))
            sims.append(dot / (math.sqrt(sum(x * x for x in va)) * math.sqrt(sum(y * y for y in vw))))
        out[t] = sum(sims) / len(sims)
    return out


def test_cv_matches_brute_force(spark):
    rnd = random.Random(3)
    vocab = ["apple", "pear", "plum", "kiwi", "lime", "fig", "date"]
    texts = [[rnd.choice(vocab) for _ in range(rnd.randint(1, 140))] for _ in range(25)] + [["zzz"]]
    topics = {0: ["apple", "pear", "plum"], 1: ["kiwi", "lime", "fig", "apple"]}
    tw = spark.createDataFrame([(t, w) for t, ws in topics.items() for w in ws], "topic int, term string")
    tx = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, tokens array<string>")
    got = {r["topic"]: r["coherence"] for r in coherence_cv_per_topic(tx, tw, "tokens", 20).collect()}
    exp = brute_cv(texts, topics, 20)
    for t in topics:
        assert abs(got[t] - exp[t]) < 1e-9


def test_lda_planted_topics_and_invariants(spark):
    from pyspark.sql import functions as F

    from threadlens.operators import topics as TP
    rnd = random.Random(5)
    a = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    b = ["red", "green", "blue", "cyan", "magenta", "yellow"]
    docs = [(i, [rnd.choice(a if i % 2 == 0 else b) for _ in range(30)]) for i in range(60)] + [(60, [])]
    d = spark.createDataFrame(docs, "doc_id int, tokens array<string>")
    vec, vocab_df, terms = TP.prepare_corpus(d, "doc_id", no_below=2, no_above=0.9)
    m = TP.fit_lda(vec, 2, 20)
    th = TP.doc_topics(m, vec, "doc_id")
    sums = [sum(r["theta"]) for r in th.filter("doc_len > 0").collect()]
    assert all(abs(s - 1.0) < 1e-6 for s in sums)
    dom = {r["doc_id"]: r["topic_id"] for r in TP.dominant_topic(th, "doc_id", 2).collect()}
    even = {dom[i] for i in range(0, 60, 2)}
    odd = {dom[i] for i in range(1, 60, 2)}
    assert len(even) == 1 and len(odd) == 1 and even != odd
    assert dom[60] == 0
    props = TP.topic_proportions(th).collect()
    assert abs(sum(r["share"] for r in props) - 1.0) < 1e-9 and sorted(r["rank"] for r in props) == [1, 2]
    m2 = TP.fit_lda(vec, 2, 20)
    w1 = [r["term"] for r in TP.topic_top_words(m, vocab_df, 3).orderBy("topic", "rank").collect()]
    w2 = [r["term"] for r in TP.topic_top_words(m2, vocab_df, 3).orderBy("topic", "rank").collect()]
    assert w1 == w2


def test_mixtures_of_documents_of_all_lengths_equal_the_plain_fixed_point(monkeypatch):
    import numpy as np

    from threadlens.operators import lda

    monkeypatch.setattr(lda, "TOLERANCE", 1e-9)
    monkeypatch.setattr(lda, "STEP_CELLS", 40)
    rng = np.random.default_rng(2)
    k, size = 3, np.array([1, 30, 2, 90, 1, 31, 7])
    starts = np.cumsum(size) - size
    terms = np.concatenate([np.sort(rng.choice(100, s, replace=False)) for s in size])
    n, beta = rng.integers(1, 4, len(terms)), rng.dirichlet(np.ones(100), k).astype(np.float32)
    gamma, share = lda.variational(n, terms, starts, beta, 1 / k, None, 400)
    for d, lo in enumerate(starts):
        at, g = slice(lo, lo + size[d]), np.ones(k)
        b = beta[:, terms[at]]
        for _ in range(400):
            t = np.exp(lda.digamma(g) - lda.digamma(g.sum()))
            g = 1 / k + t * (b * (n[at] / (t @ b))).sum(axis=1)
        assert np.allclose(gamma[d], g, rtol=1e-3, atol=1e-4)
        t = np.exp(lda.digamma(gamma[d]) - lda.digamma(gamma[d].sum()))
        assert np.allclose(share[:, at], t[:, None] * (n[at] / (t @ b)), rtol=1e-3)
