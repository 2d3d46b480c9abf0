"""Operator 9 against brute force."""

import math
import random

from threadlens.llm import maxscore


def brute(rows, asked, k):
    vecs = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        vecs[i] = min(vecs.get(i, v), v)
    quant = {i: [math.floor(256 * x) for x in v] for i, v in vecs.items()}
    out = []
    for q in sorted(set(asked) & set(quant)):
        s = sorted((-sum(a * b for a, b in zip(quant[q], v)), i) for i, v in quant.items() if i != q)
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return out


def test_top_k(spark):
    rnd = random.Random(1)
    rows = [(i, [round(rnd.gauss(0, .2), 3) for _ in range(12)]) for i in range(400)]
    rows += [(500 + i, rows[3][1]) for i in range(40)]  # many ties
    rows += [(600, None), (601, []), (602, [None] * 12), (603, [math.nan] * 12), (604, [math.inf] * 12), (605, [1.0]),
             (None, [1.0] * 12), (7, rows[8][1]), (7, rows[7][1])]
    schema = "vec_id long, embedding array<double>, v int, score int"
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], schema)
    asked = [i for i, _ in rows if i is not None and i % 5 == 0]
    queries = df.where("vec_id % 5 = 0")
    want = brute(rows, asked, 5)
    for block, shard in ((20_000, 16_384), (30, 50)):
        got = maxscore.search(df, queries, 5, block_queries=block, shard_rows=shard)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    assert maxscore.search(df.limit(0), queries, 5).count() == 0
    assert maxscore.search(df, queries.limit(0), 5).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert maxscore.search(few, few, 5).count() == 6
