"""Topic distances, layout and saliency (E9) against numpy."""

import math

import numpy as np
import pytest

from threadlens.operators import topic_map as TM


def jsd(p, q):
    m = (p + q) / 2
    part = lambda a: sum(x * math.log(x / y) for x, y in zip(a, m) if x > 0)
    return (part(p) + part(q)) / 2


@pytest.fixture(scope="module")
def phi():
    rng = np.random.default_rng(3)
    m = rng.gamma(0.3, size=(6, 25)) * (rng.random((6, 25)) < 0.6)
    m[4] = m[1]  # two equal topics
    m[5] = 0
    m[5, 24] = 1.0  # hardly shares a term
    return m / m.sum(axis=1, keepdims=True)


def rows_of(spark, m, zeros=False):
    return spark.createDataFrame([(t, f"w{w}", float(x)) for t, r in enumerate(m) for w, x in enumerate(r) if x > 0 or zeros],
                                 "topic int, term string, phi double")


def test_divergence(spark, phi):
    want = {(a, b): jsd(phi[a], phi[b]) for a in range(6) for b in range(a + 1, 6)}
    for zeros in (False, True):
        got = {(r.a, r.b): r.jsd for r in TM.js_divergence(rows_of(spark, phi, zeros)).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert got[1, 4] < 1e-12


def test_layout_is_the_two_largest_axes(spark, phi):
    div = TM.js_divergence(rows_of(spark, phi))
    d = np.zeros((6, 6))
    for r in div.collect():
        d[r.a, r.b] = d[r.b, r.a] = r.jsd
    j = np.eye(6) - 1 / 6
    w, v = np.linalg.eigh(-j @ (d * d) @ j / 2)
    got = {r.topic: r for r in TM.layout(div).collect()}
    assert max(r.residual for r in got.values()) < 1e-12
    for axis, k in (("x", -1), ("y", -2)):
        own = np.array([got[t][axis] for t in range(6)])
        want = v[:, k] * math.sqrt(max(w[k], 0))
        assert np.allclose(own, want, atol=1e-9) or np.allclose(own, -want, atol=1e-9)
        assert own[np.abs(own).argmax()] > 0
    assert (got[1].x, got[1].y) == pytest.approx((got[4].x, got[4].y), abs=1e-9)


def test_edges(spark):
    one = spark.createDataFrame([(1, "a", 1.0)], "topic int, term string, phi double")
    assert TM.layout(TM.js_divergence(one)).count() == 0
    assert TM.layout(TM.js_divergence(one.limit(0))).count() == 0
    same = spark.createDataFrame([(t, "a", 1.0) for t in (1, 2, 3)], "topic int, term string, phi double")
    assert {(r.x, r.y) for r in TM.layout(TM.js_divergence(same)).collect()} == {(0.0, 0.0)}
    apart = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0)], "topic int, term string, phi double")
    assert TM.js_divergence(apart).first().jsd == pytest.approx(math.log(2))


def test_saliency(spark):
    counts = [("t", "a", 6), ("t", "b", 2), ("u", "b", 2), ("u", "c", 0)]
    got = {r.term: r for r in TM.saliency(spark.createDataFrame(counts, "topic string, term string, n long")).collect()}
    assert set(got) == {"a", "b"}
    p = {"t": 0.8, "u": 0.2}
    d = {"a": math.log(1 / p["t"]), "b": 0.5 * math.log(0.5 / p["t"]) + 0.5 * math.log(0.5 / p["u"])}
    for w, f in (("a", 6), ("b", 4)):
        assert got[w].freq == f
        assert got[w].distinctiveness == pytest.approx(d[w])
        assert got[w].saliency == pytest.approx(f / 10 * d[w])
    top = TM.saliency(spark.createDataFrame(counts, "topic string, term string, n long"), n=1).collect()
    assert [r.term for r in top] == ["a" if 0.6 * d["a"] >= 0.4 * d["b"] else "b"]
