"""Part of speech and lemma (C2): every tag sequence of short sentences, by brute force."""

import itertools
import random

from pyspark.sql import functions as F

from threadlens.operators import tagger as TG

N = len(TG.TAGS)


def fit_of(word, g):
    own = dict(g.words)
    if word in own:
        return own[word]
    return [g.prior[t] + sum(w for e, tag, w in g.endings if tag == t and word.endswith(e)) for t in TG.TAGS]


def best_tags(words, g):
    em = [fit_of(w, g) for w in words]

    def total(tags):
        s = g.start[tags[0]] + em[0][tags[0]]
        for a, b, e in zip(tags, tags[1:], em[1:]):
            s = s + g.follows[a][b] + e[b]
        return s

    best = max(total(t) for t in itertools.product(range(N), repeat=len(words)))
    return [t for t in itertools.product(range(N), repeat=len(words)) if abs(total(t) - best) < 1e-9]


def test_best_sequence(spark):
    rnd = random.Random(4)
    words = ["the", "running", "walked", "nations", "famous", "quickly", "left", "is", "dogs", "nicest", "to", "very"]
    rows = [[rnd.choice(words) for _ in range(rnd.randint(1, 5))] for _ in range(60)]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "i int, text string")
    g = TG.Grammar()
    for r in TG.lemma_tagged(df, "text", stopwords=[]).collect():
        tags = tuple(TG.TAGS.index(p.tag) for p in r.tagged)
        assert [p.word for p in r.tagged] == rows[r.i]
        assert tags in best_tags(rows[r.i], g)


def test_context_decides(spark):
    g = TG.Grammar(words=(("the", (-9.0, -9.0, -9.0, 0.0)), ("they", (0.0, -9.0, -9.0, -9.0)), ("walks", (0.0, -0.1, -9.0, -9.0))))
    df = spark.createDataFrame([(1, "The walks. They walks!"), (2, "they walks")], "i int, text string")
    got = {r.i: [(p.word, p.tag, p.lemma) for p in r.tagged] for r in TG.lemma_tagged(df, "text", grammar=g).collect()}
    assert got[1] == [("the", "other", "the"), ("walks", "noun", "walk"), ("they", "noun", "they"), ("walks", "verb", "walk")]
    assert got[2][1][1] == "verb"


def test_lemmas_follow_the_tag(spark):
    cases = [("stories", 0, "story"), ("classes", 0, "class"), ("buses", 0, "buse"), ("glass", 0, "glass"), ("crying", 1, "cry"),
             ("walked", 1, "walk"), ("tried", 1, "try"), ("need", 1, "need"), ("happiest", 2, "happy"), ("left", 1, "leave"),
             ("left", 2, "left"), ("left", 0, "left"), ("walked", 3, "walked"), ("is", 0, "is"), ("us", 0, "us"), ("", 0, "")]
    df = spark.createDataFrame(cases, "w string, t int, want string")
    got = df.select("w", "want", TG.lemma_of(F.col("w"), F.col("t"), TG.Grammar()).alias("l")).collect()
    assert [(r.w, r.l) for r in got] == [(r.w, r.want) for r in got]


def test_awkward_texts(spark):
    texts = [None, "", "  ", "...!?", "1 2 3.", "É à", "word", "word", "long " * 3000 + "."]
    df = spark.createDataFrame([(t, "x", 1) for t in texts], "text string, tagged string, word int")
    rows = TG.lemma_tagged(df, "text").collect()
    assert len(rows) == len(texts)
    by = [(r.text, len(r.tagged), r.text_lem) for r in rows]
    assert {(t, n, lem) for t, n, lem in by if n == 0} == {(t, 0, "") for t in (None, "", "  ", "...!?", "1 2 3.", "É à")}
    assert sum(n for _, n, _ in by) == 2 + 3000
    assert TG.lemma_tagged(df.limit(0), "text").count() == 0


def test_many_rows_at_once_equal_the_column_expressions(spark):
    texts = ["The dogs walked. They are running, very quickly! 12 nicest?", None, "", "...", "left the nations left is crying",
             "a", "ÜBER naïve classes!stories " * 30, "Kelvin K. İs it", "the end"]
    df = spark.createDataFrame([(i % 7 or None, t) for i, t in enumerate(texts * 2)], "k int, t string")
    g = TG.Grammar()
    got = TG.lemma_tagged(df, "t", grammar=g)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    tags = F.transform(TG.sentences(F.col("t")), lambda s: F.zip_with(s, TG.viterbi(F.transform(s, lambda w: TG.emissions(w, g)), g),
                                                                      lambda w, t: F.struct(w, t)))
    want = df.select("k", "t", F.flatten(tags).alias("p")).collect()
    plain = sorted(str((r.k, r.t, [(p[0], TG.TAGS[p[1]]) for p in r.p])) for r in want)
    assert plain == sorted(str((r.k, r.t, [(p.word, p.tag) for p in r.tagged])) for r in got.collect())
    for r in got.collect():
        assert r.text_lem == " ".join(p.lemma for p in r.tagged if p.word not in TG.NLTK_ENGLISH)
