"""Many topic models fitted together."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import topic_batch as TB
from threadlens.operators import topics as TP

A = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
B = ["red", "green", "blue", "cyan", "magenta", "yellow"]
C = ["one", "two", "three", "four", "five", "six"]


def test_digamma():
    x = np.array([0.01, 0.5, 1.0, 3.7, 250.0])
    step = 1e-5
    from math import lgamma
    want = [(lgamma(v + step) - lgamma(v - step)) / (2 * step) for v in x]
    assert np.allclose(TB.digamma(x), want, rtol=1e-5)


def test_update_equals_the_plain_fixed_point(monkeypatch):
    """The matrix form of all models at once against one document and one model at a time."""
    monkeypatch.setattr(TB, "INNER_STEPS", 200)
    monkeypatch.setattr(TB, "TOLERANCE", 1e-9)
    monkeypatch.setattr(TB, "STEP_CELLS", 10)
    rng = np.random.default_rng(1)
    ks, n_terms, n_docs = [2, 3], 7, 5
    log_beta = np.log(rng.dirichlet(np.ones(n_terms), sum(ks)).T)
    cells = [(d, t, int(rng.integers(1, 5))) for d in range(n_docs) for t in range(n_terms) if rng.random() < .6 or t == d]
    doc, terms, counts = (np.array(x) for x in zip(*cells))
    start = np.ones((n_docs, 5), np.float32)
    gamma, stats = TB.update(counts.astype(np.float32), terms, doc, log_beta, start, ks)
    want = np.zeros((n_terms, 5))
    for lo, k in ((0, 2), (2, 3)):
        beta = np.exp(log_beta[:, lo:lo + k])
        for d in range(n_docs):
            own, n = terms[doc == d], counts[doc == d]
            g = np.ones(k)
            for _ in range(500):
                t = np.exp(TB.digamma(g) - TB.digamma(g.sum()))
                g = 1 / k + t * (beta[own] * (n / (beta[own] @ t))[:, None]).sum(axis=0)
            assert np.allclose(gamma[d, lo:lo + k], g, rtol=1e-3)
            t = np.exp(TB.digamma(g) - TB.digamma(g.sum()))
            want[own, lo:lo + k] += t * (n / (beta[own] @ t))[:, None]
    assert np.allclose(stats, want, rtol=2e-3, atol=1e-5)


def planted(spark, groups):
    rnd = random.Random(5)
    rows, doc = [], 0
    for g, kinds in groups.items():
        for i in range(60):
            words = kinds[i % len(kinds)]
            rows.append((g, doc, [rnd.choice(words) for _ in range(30)]))
            doc += 1
    return spark.createDataFrame(rows, "g long, doc long, tokens array<string>")


def test_planted_topics_in_every_group(spark):
    docs = planted(spark, {0: [A, B], 7: [B, C], 8: [A, C]})
    fitted = TB.fit_batch(TB.grouped_counts(docs, 2, 0.9), [2, 4], passes=12)
    assert fitted.topics == [(2, 0), (2, 1), (4, 0), (4, 1), (4, 2), (4, 3)]
    rows = {(r.g, r.doc): r.theta for r in fitted.theta(2).collect()}
    assert len(rows) == 180 and all(abs(sum(t) - 1) < 1e-6 for t in rows.values())
    for g, base in ((0, 0), (7, 60), (8, 120)):
        tops = [int(np.argmax(rows[g, base + i])) for i in range(60)]
        assert len(set(tops[0::2])) == len(set(tops[1::2])) == 1 and tops[0] != tops[1]
    words = {}
    for r in fitted.top_words(6).where("k = 2").collect():
        words.setdefault((r.g, r.topic), set()).add(r.term)
    assert {frozenset(v) for (g, _), v in words.items() if g == 7} == {frozenset(B), frozenset(C)}
    shares = fitted.phi().groupBy("g", "k", "topic").agg(F.sum("phi").alias("s")).collect()
    assert len(shares) == 3 * 6 and all(abs(r.s - 1) < 1e-9 for r in shares)


def test_a_group_is_fitted_as_if_alone(spark):
    """Models of several groups in one run equal those of each group by itself."""
    docs = planted(spark, {1: [A, B], 2: [B, C]})
    both = TB.fit_batch(TB.grouped_counts(docs, 2, 0.9), [2], passes=4)
    one = TB.fit_batch(TB.grouped_counts(docs.where("g = 2"), 2, 0.9), [2], passes=4)
    a = {(r.term, r.topic): r.phi for r in both.phi().where("g = 2").collect()}
    b = {(r.term, r.topic): r.phi for r in one.phi().collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-3 for k in a)


def test_search_prefers_the_planted_size_and_runs_alike(spark):
    docs = planted(spark, {0: [A, B, C]})
    got = []
    for _ in range(2):
        fitted = TB.fit_batch(TB.grouped_counts(docs, 2, 0.9), [2, 3, 6], passes=8)
        got.append([(r.k, round(r.coherence, 9), r.best) for r in TB.scored(fitted, docs, 6).orderBy("k").collect()])
    assert got[0] == got[1]
    assert [k for k, _, best in got[0] if best] == [3]


def test_no_rows_and_bad_sizes(spark):
    none = spark.createDataFrame([], "g long, doc long, term string, n int")
    fitted = TB.fit_batch(none, [2], passes=1)
    assert fitted.theta(2).count() == 0 and fitted.top_words().count() == 0
    with pytest.raises(ValueError):
        TB.fit_batch(none, [])


def test_subtopics_of_many_main_topics(spark):
    docs = planted(spark, {1: [A, B], 2: [B, C], 3: [A, C]})
    df = docs.select("doc", F.col("g").cast("string").alias("main"), F.concat_ws(" ", "tokens").alias("text"))
    few = spark.createDataFrame([(900, "9", "alpha beta"), (901, None, "alpha beta"), (902, "-1", "alpha"),
                                 (903, "1", "  "), (903, "1", None)], "doc long, main string, text string")
    out = TP.subtopics(df.unionByName(few), "doc", "main", "text", min_docs=30, k_max=3, no_below=2, no_above=0.9).collect()
    assert len(out) == 185
    by = {}
    for r in out:
        by.setdefault(r.main, []).append(r)
    assert all(r.comment_subtopic == -1 for m in ("9", None, "-1") for r in by[m])
    assert [r.comment_subtopic for r in by["1"] if r.doc == 903] == [-1, -1]
    for m in ("1", "2", "3"):
        own = [r for r in by[m] if r.doc < 900]
        assert len({r.n_subtopics for r in own}) == 1
        assert all(0 <= r.comment_subtopic < r.n_subtopics for r in own)
        sides = [{r.comment_subtopic for r in own if r.doc % 2 == s} for s in (0, 1)]
        assert not sides[0] & sides[1]


def test_one_pass_stays_on_disk(spark, monkeypatch):
    made = []
    plain = TB.scratch_path

    def noted(session, name):
        made.append(plain(session, name))
        return made[-1]

    monkeypatch.setattr(TB, "scratch_path", noted)
    rows = [(0, d, w, 1) for d in range(12) for w in ("a", "b", "c")]
    fit = TB.fit_batch(spark.createDataFrame(rows, "g long, doc long, term string, n int"), [2], passes=4)
    assert fit.weights.count() == 3 and fit.mixtures.count() == 12
    exists = [spark._jvm.java.io.File(p.removeprefix("file:")).exists() for p in made]
    # The last pass's weights and the mixtures inferred after it.
    assert exists == [False] * 3 + [True] * 2


def test_parts_and_buckets_do_not_change_the_models(spark, monkeypatch):
    """Small chunks, parts and buckets give the models of large ones; a NULL list and NULL tokens count nothing."""
    docs = planted(spark, {0: [A, B], 3: [B, C]})
    odd = spark.createDataFrame([(0, 900, None), (3, 901, [None, "zeta", "zeta"])], docs.schema)
    docs = docs.unionByName(odd)
    whole = TB.fit_documents(docs, [2, 3], passes=3)
    monkeypatch.setattr(TB, "CHUNK_TOKENS", 200)
    monkeypatch.setattr(TB, "PART_CELLS", 60)
    monkeypatch.setattr(TB, "BUCKET_BYTES", 400)
    small = TB.fit_documents(docs, [2, 3], passes=3)
    a, b = ({(r.g, r.term, r.k, r.topic): r.phi for r in f.phi().collect()} for f in (whole, small))
    assert a.keys() == b.keys() and all(abs(a[x] - b[x]) < 1e-3 for x in a)
    a, b = ({(r.g, r.doc): r.theta for r in f.theta(3).collect()} for f in (whole, small))
    assert a.keys() == b.keys() and (0, 900) not in a and (3, 901) in a
    assert all(np.allclose(a[x], b[x], atol=1e-2) for x in a)
    tops = [{(r.g, r.k, r.topic, r.term) for r in f.top_words(4).collect()} for f in (whole, small)]
    assert tops[0] == tops[1]


def test_a_pass_has_few_rows_and_leaves_no_shuffle_setting(spark, monkeypatch):
    """A pass writes a row for each part and bucket, not for each term and document."""
    made = []
    plain = TB.scratch_path
    monkeypatch.setattr(TB, "scratch_path", lambda *a: made.append(plain(*a)) or made[-1])
    from threadlens.operators import common
    before = spark.conf.get(common._CLEANUP, None)
    docs = planted(spark, {0: [A, B, C]})
    TB.fit_batch(TB.grouped_counts(docs, 2, 0.9), [2], passes=1, infer=False)
    assert spark.read.parquet(made[-1]).count() <= 16  # 18 terms, 60 documents
    assert spark.conf.get(common._CLEANUP, None) == before


def test_packed_numbers_come_back():
    for a in ([], [0], [3, 255, 0], [3, 256, 70_000, 2**31 - 1]):
        assert TB.unpacked(TB.packed(np.array(a, np.int64)), len(a)).tolist() == a
