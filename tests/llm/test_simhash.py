"""Operator 2 against brute force."""

import random

import numpy as np
import xxhash

from threadlens.llm import simhash

from .fixtures import awkward_docs


def brute_components(fps, max_bits):
    arr = np.array(fps, np.uint64)
    near = np.bitwise_count(arr[:, None] ^ arr[None, :]) <= max_bits
    comp = [-1] * len(fps)
    for i in range(len(fps)):
        if comp[i] < 0:
            todo, comp[i] = [i], i
            while todo:
                for v in np.flatnonzero(near[todo.pop()]):
                    if comp[v] < 0:
                        comp[v] = i
                        todo.append(v)
    return comp


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint():
    for t in (None, "", " ", "One", "one two", "One two three four FIVE Ünder ünder", "a b c " * 700):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_links_of_dense_clusters(spark):
    rnd = random.Random(3)
    fps = {0, (1 << 64) - 1, *(rnd.getrandbits(64) for _ in range(100))}
    for _ in range(3):
        base = rnd.getrandbits(64)
        for _ in range(250):
            x = base
            for k in rnd.sample(range(64), rnd.randint(0, 4)):
                x ^= 1 << k
            fps.add(x)
    fps = sorted(fps, key=lambda x: x - (x >> 63 << 64))
    signed = [x - (x >> 63 << 64) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for limit in (512, 20):
        roots = {r.node: r.root for r in simhash.components(simhash.links(df, 2, limit)).collect()}
        want = brute_components(fps, 2)
        assert [roots.get(x, x) for x in signed] == [signed[c] for c in want]


def test_rows_and_dedup(spark):
    docs = awkward_docs(spark, extra=[(9, None), (None, None)])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    comp = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert comp == {1: 1, 6: 1, 2: 2, 3: 2, 4: 2, 9: 2, 5: 5, 7: 7, 8: 8}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.select("doc_id", "text").collect() if r.text) == sorted(
        [(1, "The quick brown fox jumps over the lazy dog again and again"), (0, "no id here at all"), (7, "twice"),
         (8, "é ñ 日本語 🙂 a@b.c"), (5, docs.where("doc_id = 5").first().text)])
    assert kept.where("text is null").count() == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.deduplicate(docs.limit(0)).count() == 0
