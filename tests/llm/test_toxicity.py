"""Operator 3: automaton against plain edit distance, context, held-out accuracy."""

import random

import pytest

from threadlens.llm import toxicity as T

from .fixtures import awkward_docs

SF01 = "/root/testdata/sf0.01"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[j] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_automaton_finds_what_edit_distance_finds(edits):
    rnd = random.Random(2)
    terms = ["idiot", "moron", "worthless", "abcab", "babab"]
    trie = T.Trie({t: (1.0 + i, False) for i, t in enumerate(terms)}, edits)
    words = [w for t in terms for w in (t, t[1:], t[:-1], t + "x", "x" + t, t[:2] + "z" + t[3:], t[::-1])]
    words += ["".join(rnd.choice("abidotmrn") for _ in range(rnd.randint(3, 7))) for _ in range(500)]
    for w in words:
        near = [t for t in terms if distance(w, t) <= edits]
        got = trie.match(w)
        assert (got is not None) == bool(near), w
        if w in terms:
            assert got == (1.0 + terms.index(w), 0)


def with_swaps(a, b):
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a):
        rows.append([i + 1])
        for j, y in enumerate(b):
            swap = [rows[i - 1][j - 1] + 1] if i and j and (x, a[i - 1]) == (b[j - 1], y) else []
            rows[-1].append(min(rows[-1][j] + 1, rows[i][j + 1] + 1, rows[i][j] + (x != y), *swap))
    return rows[-1][-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_automaton_finds_misspelled_stems(edits):
    rnd = random.Random(3)
    stems = ["lowei", "achlich", "bomente"]
    trie = T.Trie({t: (1.0, True) for t in stems}, edits)
    words = [w + end for t in stems for end in ("", "s", "keiten") for i in range(len(t))
             for w in (t[:i] + t[i + 1:], t[:i] + "z" + t[i + 1:], t[:i] + "z" + t[i:])]
    words += ["".join(rnd.choice("lowebmnt") for _ in range(rnd.randint(3, 9))) for _ in range(500)]
    found = 0
    for w in words:
        want = any(len(w) >= len(t) and min(with_swaps(t, w[:n]) for n in range(len(w) + 1)) <= edits for t in stems)
        assert (trie.match(w) is not None) == want, w
        found += want
    assert found > 60


DISGUISED = ("id1ot", "idi0t", "st*pid", "wor-thless", "st_pid", "idoit", "stpuid", "iidot", "scmu", "jrek", "j3rk",
             "jerrk", "you're-an-id1ot", "wrothless", "pahtetic")


def test_disguised_spellings():
    model = T.Model({w: (T.SEED_WEIGHT, False) for w in T.SEEDS} | {"achlich": (3.0, True)},
                    weights=(2.0, 0.5, 0.3, 1.0, 0.3), bias=-3.0)
    trie = T.Trie(model.entries)
    for w in (*DISGUISED, "ahclichkeit", "achl1chkeit", "ach-lichkeit", "aclhich"):
        assert T.features(f"you are so {w} today", trie, frozenset(), {})[1] > 0, w
    plain = T.features("you are so id1ot today", trie, frozenset(), {})
    said = T.features('he wrote "id1ot" today', trie, frozenset(), {})
    assert plain[1] > said[1] > 0 and plain[4] > said[4]
    for t in ("a well-known 3rd-party half-time e-mail of x2y", "idi ot", "id  ot"):
        assert T.features(t, trie, frozenset(), {}) == (0.0,) * 5, t
    assert T.features("id1ot", trie, frozenset({"id1ot"}), {}) == (0.0,) * 5
    for t in ("a" * 200_000, "a." * 100_000, "a" + "." * 200_000, "1a" * 100_000):
        T.features(t, trie, frozenset(), {})


def test_stem_and_context():
    trie = T.Trie({"lowei": (3.0, True), "idiot": (2.0, False)})
    assert trie.match("loweischaft") == (3.0, 0) and trie.match("lowe") is None
    plain = T.features("you are an idiot today", trie, frozenset(), {})
    said = T.features('he wrote "idiot" today', trie, frozenset(), {})
    assert plain[0] > said[0] and plain[4] > said[4]
    assert T.features(None, trie, frozenset(), {}) == T.features("", trie, frozenset(), {}) == (0.0,) * 5


def test_rows(spark):
    docs = awkward_docs(spark, extra=[(20, "you stupid worthless idiot"), (21, "you stupidd moron")])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    assert got[20].predicted == 1 and got[21].predicted == 1 and got[2].predicted == 0 and got[2].score == got[3].score
    assert T.clean(docs, labels).count() == docs.count() - 2
    assert T.score(docs.limit(0), model).count() == 0
    ambiguous = spark.createDataFrame([(20, 1), (20, 0), (1, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    T.score(docs, T.fit(docs, ambiguous)).collect()


def test_rare_terms_of_large_samples(spark):
    rows = [(f"some text with zorgle{i % 2} here", 1) for i in range(20)] + [("some text with nothing here", 0)] * 20
    got = T.learn_lexicon(spark.createDataFrame(rows, "text string, y int"), 4000, 16000)
    assert any("zorgle0".startswith(w) for w in got)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF01}/documents.parquet"), spark.read.parquet(f"{SF01}/labels.parquet")
    got = T.score(docs, T.fit(docs, labels)).join(labels, "doc_id").where(T.held_out(T.F.col("doc_id")))
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 8 and n.get((0, 1), 0) <= 2


def test_scores_where_workers_lack_the_package(tmp_path):
    """A session whose workers can't import the package scores all the same."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from threadlens.session import get_session
from threadlens.llm import toxicity
spark = get_session("local[1]", 1)
model = toxicity.Model({{w: (4.0, False) for w in toxicity.SEEDS}}, weights=(2.0, .5, .3, 1.0, .3), bias=-3.0)
word = sorted(toxicity.SEEDS)[0]
rows = spark.createDataFrame([(1, "you " + word + " " + word), (2, "nice day")], "doc_id long, text string")
print("GOT", [r.predicted for r in toxicity.score(rows, model).orderBy("doc_id").collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "GOT [1, 0]" in out.stdout, out.stderr[-2000:]


def test_every_labelled_row_is_learned_from(spark):
    n = 20_400
    docs = spark.range(n).selectExpr("id doc_id", "concat('word', id % 7, ' text') text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 5 = 0 as int) toxic")
    got = T.labelled(docs.unionByName(docs), labels, "doc_id", "text", "doc_id", "toxic")
    want = labels.where(~T.held_out(labels.doc_id)).count()
    many = spark.range(40_000).selectExpr("id doc_id", "'a' text")
    whole = T.labelled(many, many.selectExpr("doc_id", "0 toxic"), "doc_id", "text", "doc_id", "toxic").count()
    assert got.count() == 2 * want and whole == many.where(~T.held_out(many.doc_id)).count() > 20_000


def test_counts_are_flushed_and_summed(spark, monkeypatch):
    rows = spark.createDataFrame([("a b", 1), ("a c", 0), (None, 0), ("a b d", 1)], "text string, y int").coalesce(1)
    monkeypatch.setattr(T, "COUNTED", 1)
    got = {r.w: (r.toxic, r.clean) for r in T._counts(rows, set).collect()}
    assert got == {"a": (2, 1), "b": (2, 0), "c": (0, 1), "d": (1, 0)}


def test_forms_are_words_and_pairs_about_one_symbol():
    low = "id1ot a.b  c - d wor-thless x__y e_f2g é'ü 3rd"
    assert T.forms(low) == {"id", "ot", "id1ot", "a", "b", "a.b", "c", "d", "wor", "thless", "wor-thless", "x", "y",
                            "e", "f", "g", "e_f", "f2g", "é", "ü", "é'ü", "rd"}


def test_automaton_takes_few_steps():
    import sys

    trie = T.Trie({w: (1.0, False) for w in T.SEEDS})
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        assert trie.fuzzy("wrothless") == (1.0, 1)
    finally:
        sys.setprofile(None)
    assert calls < 400, calls
