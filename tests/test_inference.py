"""Given models (E1 with fixed topics, D4 with stored weights) and physical row order."""

import math
import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import inference as INF
from threadlens.sources import io as IO


def fixed_point(cells, k, alpha, tolerance, steps):
    theta = [1 / k] * k
    total = sum(n for n, _ in cells)
    moved = math.inf
    for _ in range(steps):
        new = [alpha] * k
        for n, phi in cells:
            s = sum(t * p for t, p in zip(theta, phi))
            for j in range(k):
                new[j] += n * theta[j] * phi[j] / s if s else 0
        new = [x / (total + alpha * k) for x in new]
        moved = max(abs(a - b) for a, b in zip(new, theta))
        theta = new
        if moved < tolerance:
            break
    return theta, moved < tolerance


def test_mixtures_equal_the_plain_fixed_point(spark):
    rnd = random.Random(2)
    phi = {f"w{i}": [rnd.random() ** 3 for _ in range(3)] for i in range(12)}
    phi["w0"] = [0.0, 0.0, 1.0]
    docs = {d: [(f"w{rnd.randrange(14)}", rnd.randint(1, 4)) for _ in range(rnd.randint(1, 9))] for d in range(25)}
    docs[90] = [("w13", 3)]  # no topic knows it
    rows = [(d, t, n) for d, ws in docs.items() for t, n in dict(ws).items()]
    counts = spark.createDataFrame(rows, "doc long, term string, n long")
    table = spark.createDataFrame(list(phi.items()), "term string, phi array<double>")
    got = {r.doc: r for r in INF.infer_mixtures(counts, table, 0.2, 1e-7, 300).collect()}
    want = {d: [(n, phi[t]) for t, n in dict(ws).items() if t in phi] for d, ws in docs.items()}
    want = {d: c for d, c in want.items() if c}
    assert got.keys() == want.keys() and 90 not in got
    for d, cells in want.items():
        theta, done = fixed_point(cells, 3, 0.2, 1e-7, 300)
        assert got[d].theta == pytest.approx(theta, abs=1e-9) and got[d].converged == done
        assert sum(got[d].theta) == pytest.approx(1)
        bound = sum(n * math.log(sum(t * p for t, p in zip(theta, v))) for n, v in cells) + 0.2 * sum(map(math.log, theta))
        assert got[d].bound == pytest.approx(bound)


def test_no_step_lowers_the_bound(spark):
    counts = spark.createDataFrame([(1, "a", 3), (1, "b", 2), (1, "c", 7)], "doc long, term string, n long")
    phi = spark.createDataFrame([("a", [.7, .1]), ("b", [.2, .3]), ("c", [.1, .6])], "term string, phi array<double>")
    bounds = [INF.infer_mixtures(counts, phi, 0.1, 0.0, n).first().bound for n in (1, 2, 3, 5, 20)]
    assert bounds == sorted(bounds)
    assert INF.infer_mixtures(counts.limit(0), phi).count() == 0


def test_stored_weights(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc long")
    counts = spark.createDataFrame([(1, "good", 2), (1, "x", 5), (2, "bad", 1)], "doc long, term string, n long")
    w = spark.createDataFrame([("good", "pos", 1.0), ("good", "neg", -1.0), ("bad", "neg", 0.5), ("bad", "neg", 0.5)],
                              "term string, label string, weight double")
    b = spark.createDataFrame([("pos", 0.0), ("neg", 0.0), ("mid", 0.0)], "label string, bias double")
    got = {r.doc: (r.bert_label, r.bert_score) for r in INF.score_with_weights(docs, counts, w, b).collect()}
    assert got[1] == ("pos", pytest.approx(1 / (1 + math.exp(-2) + math.exp(-4))))
    assert got[2] == ("neg", pytest.approx(1 / (1 + 2 * math.exp(-1))))
    assert got[3] == ("mid", pytest.approx(1 / 3))  # ties go by the label


def test_positions_over_several_files(spark):
    path = IO.scratch_path(spark, "order")
    for name, ids in (("b", [5, 6, 7]), ("a", [3, 1, 2]), ("c", [9])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.parquet(f"{path}/part={name}")
    rows = IO.with_position(spark, path).orderBy("position").collect()
    assert [(r.position, r.id) for r in rows] == list(enumerate([3, 1, 2, 5, 6, 7, 9]))
    assert sorted(r.id for r in IO.prefix_in_file_order(spark, path, 4).collect()) == [1, 2, 3, 5]
    assert IO.prefix_in_file_order(spark, path, 0).count() == 0
    assert IO.prefix_in_file_order(spark, path, 99).count() == 7


def test_positional_concat_checks_its_frames(spark):
    a = spark.createDataFrame([(0, "x"), (1, None), (2, "z")], "position long, a string")
    b = a.select("position", F.length("a").alias("n"))
    got = IO.positional_concat(a, b).orderBy("position").collect()
    assert [(r.a, r.n) for r in got] == [("x", 1), (None, None), ("z", 1)]
    for bad in (b.limit(2), b.where("position <> 1"), b.unionByName(b),
                b.withColumn("position", F.when(F.col("position") > 0, F.col("position"))),
                b.withColumn("position", F.col("position") + 1), b.withColumnRenamed("n", "a")):
        with pytest.raises(ValueError):
            IO.positional_concat(a, bad)
    assert IO.positional_concat(a.limit(0), b.limit(0)).count() == 0
