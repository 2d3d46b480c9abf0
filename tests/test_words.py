"""Words of text batches, and the jobs that take them from there."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from threadlens.operators import inference as INF
from threadlens.operators import words as WO

TEXTS = ["The cat, the CAT", None, "", "a", "x1y2", "naïve İstanbul ß end", "end", "12 34", "z" * 300 + " z"]


def test_letter_runs_equal_a_pattern():
    import pyarrow as pa

    texts = [t and t.lower() for t in TEXTS]
    for lo in range(len(texts)):
        words, row, data, start = WO.letter_runs(pa.array(["skipped", *texts[lo:]]).slice(1))
        want = [(i, w) for i, t in enumerate(texts[lo:]) for w in re.findall("[a-z]+", t or "")]
        assert list(zip(row.tolist(), words.to_pylist())) == want
        assert [chr(data[s]) for s in start] == [w[0] for _, w in want]
    batch = pa.record_batch([pa.array(texts)], names=["t"])
    assert [p.column(0).to_pylist() for p in WO.slices(batch, 0, 4)] != [texts]
    assert sum((p.column(0).to_pylist() for p in WO.slices(batch, 0, 4)), []) == texts


def test_counted_words(spark):
    rows = [(i % 4 or None, t) for i, t in enumerate(TEXTS * 2)]
    got = WO.counted_words(spark.createDataFrame(rows, "doc long, text string"), "text").collect()
    lower = spark.createDataFrame(rows, "doc long, text string").select("doc", F.lower("text").alias("t")).collect()
    want = collections.Counter((r.doc, w, n) for r in lower for w, n in collections.Counter(re.findall("[a-z]+", r.t or "")).items())
    assert collections.Counter((r.doc, r.term, r.n) for r in got) == want


def test_mixtures_of_cells_in_pieces_and_totals(spark):
    whole = [(d, f"w{i % 7}", 1 + (d * i) % 3) for d in range(40) for i in range(d % 6 + 1)] + [(None, "w1", 2)]
    pieces = [(d, t, 1) for d, t, n in whole for _ in range(n)]
    phi = spark.createDataFrame([(f"w{i}", [0.1 + i, 1.0 / (1 + i), 0.3]) for i in range(5)], "term string, phi array<double>")
    a, b = ({r.doc: r for r in INF.infer_mixtures(spark.createDataFrame(x, "doc long, term string, n long"), phi).collect()}
            for x in (whole, pieces))
    assert a.keys() == b.keys()
    for d in a:
        assert a[d].theta == pytest.approx(b[d].theta, abs=1e-4) and a[d].bound == pytest.approx(b[d].bound, abs=1e-4)
        assert a[d].total == b[d].total == sum(n for x, t, n in whole if x == d and t < "w5")


def test_topics_of_planted_words_with_odd_rows(spark):
    import numpy as np

    from threadlens.operators import topics as TP

    rows = [(i % 50 or None, [f"{'ab'[i % 2]}{(i * j) % 9}" for j in range(1, 20)] + [None, "rare"][:i % 3]) for i in range(120)]
    rows += [(500, []), (501, None), (502, ["unknown"])]
    d = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    vec, vocab_df, n = TP.prepare_corpus(d, "doc_id", no_below=2, no_above=0.6)
    terms = [r.term for r in vocab_df.orderBy("term_id").collect()]
    assert n == len(terms) and "unknown" not in terms and "rare" in terms
    for r in vec.collect():
        cells = np.frombuffer(r.cells, np.int32).reshape(-1, 2)
        assert r.n_own == cells[:, 1].sum() and r.last == (cells[-1, 0] if len(cells) else None)
        assert list(cells[:, 0]) == sorted(set(cells[:, 0].tolist()))
    model = TP.fit_lda(vec, 2, 15)
    th = TP.doc_topics(model, vec, "doc_id").collect()
    assert len(th) == len(rows)
    known = set(terms)
    size = {}
    for key, words in rows:
        size[key] = size.get(key, 0) + sum(w in known for w in words or [])
    for r in th:
        assert r.doc_len == (size[r.doc_id] if r.doc_id is not None else 0)
        assert sum(r.theta) == pytest.approx(1) if r.doc_id not in (500, 501, 502) else r.theta == [0.0, 0.0]
    top = {t: {x.term[0] for x in TP.topic_top_words(model, vocab_df, 4).collect() if x.topic == t} for t in (0, 1)}
    assert sorted(top.values(), key=str) == [{"a"}, {"b"}]
