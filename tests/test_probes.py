"""Cases that once gave wrong results: edge blanks, repeated and NULL keys, absent words, empty sources."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.operators import coherence, common, contagion, phrases, sentiment, text_ops, vocab
from threadlens.sources import collect, io


def test_csv_keeps_blanks_nulls_and_empty_texts(spark, tmp_path):
    rows = [(1, " lead "), (2, ""), (3, None), (4, 'a "q"\nb,\tc '), (5, "\n"), (6, '"')]
    df = spark.createDataFrame(rows, "k int, t string")
    io.write_csv(df, f"{tmp_path}/c")
    back = io.read_csv(spark, f"{tmp_path}/c", df.schema)
    assert sorted(map(tuple, back.collect())) == rows


def test_malformed_csv_rows_are_counted(spark, tmp_path):
    (tmp_path / "m.csv").write_text("k,t\n1,a\nx,b\n3,c\n")
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("t", T.StringType())])
    assert io.malformed_rows(spark, str(tmp_path / "m.csv"), schema) == 1


def test_blank_comment_takes_post_text(spark):
    df = spark.createDataFrame([("\n", "post"), (" ", "post"), (" x", "post")], "comment_text_raw string, post_text_raw string")
    df = df.withColumn("comment_text_clean", F.col("comment_text_raw")).withColumn("post_text_clean", F.col("post_text_raw"))
    assert [r.sentiment_text for r in text_ops.sentiment_text(df).collect()] == ["post", "post", " x"]
    t = spark.createDataFrame([("\n\t",), (None,), ("ok",)], "t string")
    assert [r.m for r in t.select(sentiment.model_input_text("t").alias("m")).collect()] == ["neutral", "neutral", "ok"]


def test_lexicon_scores_each_row(spark):
    lex = spark.createDataFrame([("good", 2.0), ("bad", -2.0), ("bad", -1.0)], "term string, valence double")
    df = spark.createDataFrame([(1, "good"), (1, "bad"), (None, "good"), (None, "bad"), (2, None)], "k int, t string")
    got = sentiment.lexicon_scores(df, "t", lex, "k").collect()
    label = lambda k: sorted(r.vader_label for r in got if r.k == k)
    assert len(got) == 5 and label(1) == label(None) == ["negative", "positive"] and label(2) == ["neutral"]


def test_phrases_do_not_cross_rows_of_one_key(spark):
    docs = spark.createDataFrame([(1, ["x", "y"]), (1, ["p", "q"]), (None, ["y", "x", "y"]), (None, [])],
                                 "k int, tokens array<string>")
    table = spark.createDataFrame([(f"x{phrases.DELIM}y",)], "phrase string")
    got = sorted((r.k or 0, r.tokens) for r in phrases.merge_phrases(docs, table, "k").collect())
    assert got == [(0, []), (0, ["y", f"x{phrases.DELIM}y"]), (1, ["p", "q"]), (1, [f"x{phrases.DELIM}y"])]


def test_coherence_of_an_absent_word(spark):
    texts = spark.createDataFrame([(["a", "b"],), (["a", "c"],)], "tokens array<string>")
    top = spark.createDataFrame([(0, "a"), (0, "b"), (0, "nowhere"), (1, "gone"), (1, "lost")], "topic int, term string")
    got = {r.topic: r.coherence for r in coherence.coherence_cv_per_topic(texts, top).collect()}
    assert got[1] == 0.0 and got[0] is not None


def test_first_label_that_is_not_null(spark):
    df = spark.createDataFrame([("p", 1, 1, None), ("p", 2, 2, "negative"), ("p", 3, 3, "positive"), ("q", 1, 4, None)],
                               "post_id string, ord int, comment_id int, lab string")
    got = {r.post_id: r.post_label for r in contagion.post_comment_pairs(df, "lab", ["ord"]).collect()}
    maps = {r.post_id: r.post_label for r in contagion.post_label_maps(df, "lab", ["ord"]).collect()}
    assert got == maps == {"p": "negative", "q": None}


def test_empty_source_is_flagged(spark):
    selected = spark.createDataFrame([(1, "s1", "hot", 0), (2, "s1", "hot", 1)], "post_id int, source string, method string, dup_count int")
    comments = spark.createDataFrame([(1, "text"), (1, None)], "post_id int, body string")
    asked = spark.createDataFrame([("s1", "hot"), ("s2", "hot")], "source string, method string")
    got = {r.source: r for r in collect.counters(selected, comments, "post_id", "source", "body", asked).collect()}
    assert (got["s1"].posts_kept, got["s1"].comments_kept, got["s1"].empty_source) == (2, 1, False)
    assert (got["s2"].posts_kept, got["s2"].comments_kept, got["s2"].empty_source) == (0, 0, True)


def test_vocabulary_drops_nothing_by_default(spark):
    docs = spark.range(120_000).select(F.array(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("tokens"))
    assert vocab.vocabulary(docs, no_below=1, no_above=1.0).count() == 120_000


def test_number_rows_is_the_place_in_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    assert common.number_rows(df, "v").where("n != v").count() == 0


def test_broadcast_is_bound_by_bytes(spark):
    df = spark.createDataFrame([("x" * 100,)] * 50, "t string")
    hint = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hint(common.broadcast_if_small(df)) and not hint(common.broadcast_if_small(df, 1000))
