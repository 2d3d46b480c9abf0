"""Phrase scores and greedy merge against brute-force Python."""

import random
from collections import Counter

from pyspark.sql import functions as F

from threadlens.operators import phrases as PH


def brute_dictionary(docs):
    c = Counter()
    for toks in docs:
        for i, w in enumerate(toks):
            c[w] += 1
            if i > 0:
                c[toks[i - 1] + "_" + w] += 1
    return c


def brute_phrases(docs, min_count, threshold):
    vocab = brute_dictionary(docs)
    out = {}
    for key, n in vocab.items():
        parts = key.split("_")
        if len(parts) < 2:
            continue
        a, b = vocab.get(parts[0], 0), vocab.get(parts[-1], 0)
        if a <= 0 or b <= 0:
            continue
        s = (n - min_count) / (a * b) * len(vocab)
        if s > threshold:
            out[key] = s
    return out


def brute_merge(toks, phrases):
    out, i = [], 0
    while i < len(toks):
        if i + 1 < len(toks) and (toks[i] + "_" + toks[i + 1]) in phrases:
            out.append(toks[i] + "_" + toks[i + 1])
            i += 2
        else:
            out.append(toks[i])
            i += 1
    return out


def _frame(spark, docs):
    return spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "doc_id long, tokens array<string>")


def test_scores_match_brute_force(spark):
    rnd = random.Random(7)
    words = ["a", "b", "c", "d", "e", "f"]
    docs = [[rnd.choice(words) for _ in range(rnd.randint(0, 30))] for _ in range(60)]
    docs += [["new", "york", "x"]] * 8 + [[]]
    got = {r["phrase"]: r["score"] for r in PH.learn_phrases(_frame(spark, docs), "tokens", 5, 1.0).collect()}
    exp = brute_phrases(docs, 5, 1.0)
    assert set(got) == set(exp)
    for k in exp:
        assert abs(got[k] - exp[k]) < 1e-9


def test_greedy_merge_matches_loop(spark):
    rnd = random.Random(11)
    words = ["a", "b", "c"]
    docs = [[rnd.choice(words) for _ in range(rnd.randint(0, 25))] for _ in range(200)]
    docs.append(["a", "b", "c", "d"])  # chain of overlapping phrases
    phrase_keys = ["a_b", "b_c", "c_d", "b_a"]
    ph = spark.createDataFrame([(k,) for k in phrase_keys], "phrase string")
    merged = PH.merge_phrases(_frame(spark, docs), ph, "doc_id", "tokens", "m")
    got = {r["doc_id"]: r["m"] for r in merged.collect()}
    for i, d in enumerate(docs):
        assert got[i] == brute_merge(d, set(phrase_keys)), (i, d)
    assert got[len(docs) - 1] == ["a_b", "c_d"]


def test_merge_preserves_token_order(spark):
    docs = [["x", "new", "york", "y", "new", "york"]]
    ph = spark.createDataFrame([("new_york",)], "phrase string")
    m = PH.merge_phrases(_frame(spark, docs), ph, "doc_id", "tokens", "m").first()["m"]
    assert m == ["x", "new_york", "y", "new_york"]
    assert "_".join(m).replace("_", " ").split() == docs[0]


def test_two_pass_runs(spark):
    docs = [["new", "york", "city", "x"]] * 12 + [["a", "b"]] * 3
    res, p1, p2 = PH.learn_and_merge(_frame(spark, docs), "doc_id", "tokens", 5, 1.0)
    rows = res.join(_frame(spark, docs), "doc_id").orderBy("doc_id").collect()
    assert len(rows) == len(docs)
    assert all(len(r["phrased"]) <= len(r["tokens"]) for r in rows)
    assert all(" ".join(r["phrased"]).replace("_", " ") == " ".join(r["tokens"]) for r in rows)


def test_merging_in_rows_equals_the_window_form(spark):
    rows = [(1, ["a", "b", "a", "b", "c"]), (1, ["a", "a", "b"]), (None, ["b_c", None, "a_b", "a", None]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    keys = spark.createDataFrame([("a_b",), ("b_a",), ("a_a",), ("b_c",)], "phrase string")
    got = PH.merge_phrases(df, keys, "doc_id", "tokens", "m")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = PH._merged_by_window(df, keys, "doc_id", "tokens", "m")
    order = lambda d: sorted(map(str, d.collect()))
    assert order(got) == order(want)


def test_group_numbers_go_on_and_off_in_the_row():
    import pyarrow as pa
    tokens = pa.array([["x"], ["a", None, "b_c"], None, [], ["a"]], pa.list_(pa.string())).slice(1)
    of = pa.array([{"g": 9, "doc": 0}, {"g": -5, "doc": 1}, {"g": 2, "doc": 2}, {"g": 3, "doc": 3}, {"g": 12, "doc": 4}]).slice(1)
    marked = PH.with_groups(tokens, of)
    assert marked.to_pylist() == [["-5\x1fa", None, "-5\x1fb_c"], None, [], ["12\x1fa"]]
    assert PH.without_groups(marked).to_pylist() == tokens.to_pylist()
    assert PH.without_groups(pa.array([["-5\x1fa_-5\x1fb"]])).to_pylist() == [["a_b"]]


def test_grouped_phrases_are_merged_and_unmarked_in_one_pass(spark):
    rows = [(g, d, ["new", "york", "is", words[d % 3]]) for g, words in ((1, "abc"), (-2, "def")) for d in range(40)]
    docs = spark.createDataFrame(rows + [(1, 99, None)], "g long, doc long, tokens array<string>")
    got = {(r.g, r.doc): r.tokens for r in PH.phrases_in_groups(docs, 3, 0.2).collect()}
    assert got[1, 0][0] == "new_york" and got[-2, 1][0] == "new_york" and got[1, 99] == [] and len(got) == 81
    marked = docs.selectExpr("struct(g, doc) _of", "transform(tokens, t -> concat(g, '\x1f', t)) tokens")
    merged, _, _ = PH.learn_and_merge(marked, "_of", "tokens", 3, 0.2, grouped=True)
    assert all("\x1f" not in t for r in merged.collect() for t in r.phrased)


def test_counted_keys_with_nulls_against_plain_counts():
    import collections
    import pyarrow as pa
    rows = [["a", "b", None], [None, None, "a"], None, [], ["a", "b", "a_b"], ["a"]]
    keys, counts = PH.counted_keys(pa.array(rows, pa.list_(pa.string())))
    want = collections.Counter()
    for r in rows:
        for i, t in enumerate(r or []):
            want[t] += 1
            if i:
                want["_".join(x for x in r[i - 1:i + 1] if x is not None)] += 1
    got = collections.Counter()
    for key, n in zip(keys.to_pylist(), counts.to_pylist()):
        got[key] += n
    assert got == want


def test_counted_tables_are_deleted_once_phrases_are_learned(spark, monkeypatch):
    import os
    from threadlens.operators.common import materialize, release
    from threadlens.sources import io
    made = []
    plain = io.scratch_path
    monkeypatch.setattr(io, "scratch_path", lambda *a: made.append(plain(*a)) or made[-1])
    docs = _frame(spark, [["new", "york", "is", w] for w in "abc" * 20])
    res, _, _ = PH.learn_and_merge(docs, "doc_id", "tokens", 5, 0.1)
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(made) == 8 and len(left) == 3  # the tokens and two phrase tables
    merged = materialize(res)
    release(res)
    assert not os.path.exists(made[0].removeprefix("file:")) and merged.first()["phrased"][0] == "new_york"
