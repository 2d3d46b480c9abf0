"""F-family operators on small literal frames (null, tie and edge cases)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadlens.operators import agreement as AG
from threadlens.operators import contagion as CT
from threadlens.operators import distributions as D
from threadlens.operators import trends as TR
from threadlens.operators import users as US


def ts(y, m=1, d=1):
    return dt.datetime(y, m, d)


def test_label_share_by_year_denominator_and_nulls(spark):
    rows = [(ts(2020), "positive"), (ts(2020), "negative"), (ts(2020), None), (ts(2021), "neutral"),
            (None, "positive")]
    df = spark.createDataFrame(rows, "comment_created_utc timestamp, l string")
    got = {r["year"]: r for r in D.label_share_by_period(df, "l", "year").collect()}
    assert set(got) == {2020, 2021}
    assert got[2020]["positive"] == 0.5 and got[2020]["neutral"] == 0.0
    assert got[2021]["neutral"] == 1.0


def test_overall_shares_count_null_labels(spark):
    df = spark.createDataFrame([("positive", "negative"), (None, "negative")], "vader_label string, bert_label string")
    r = D.overall_label_shares(df).first()
    assert r["vader_positive_pct"] == 0.5 and r["bert_negative_pct"] == 1.0 and r["n_rows"] == 2


def test_topic_distribution_null_bucket_and_zero(spark):
    df = spark.createDataFrame([(None, "positive", None), (1, None, None), (1, "negative", "neutral")],
                               "topic_id int, vader_label string, bert_label string")
    got = {r["topic"]: r for r in D.topic_label_distribution(df).collect()}
    assert got["None"]["vader_pos_pct"] == 1.0 and got["None"]["bert_neu_pct"] == 0.0
    assert got["1"]["n_rows"] == 2 and got["1"]["vader_neg_pct"] == 1.0


def test_topic_change_absent_topics_and_single_year(spark):
    rows = [(2020, 0, 0.5), (2020, 1, 0.5), (2021, 0, 0.2), (2021, 1, 0.3), (2021, 2, 0.5), (2022, 0, 1.0)]
    ty = spark.createDataFrame(rows, "year int, topic int, share double")
    got = {r["topic"]: round(r["change"], 9) for r in TR.topic_change(ty).collect()}
    assert got == {0: 0.5, 1: -0.5, 2: 0.0}
    single = spark.createDataFrame([(2020, 0, 1.0)], "year int, topic int, share double")
    assert TR.topic_change(single).count() == 0


def test_gain_loss_overlap_with_few_topics(spark):
    ch = spark.createDataFrame([(0, 0.1), (1, -0.2), (2, 0.05), (3, 0.0)], "topic int, change double")
    rows = TR.gain_loss_top(ch, 3).collect()
    gain = [r["topic"] for r in rows if r["side"] == "gaining"]
    lose = [r["topic"] for r in rows if r["side"] == "losing"]
    assert gain == [0, 2, 3] and lose == [1, 3, 2]


# Golden pair: yearly model-B shares published by the reference (6 rows).
BERT_YEARLY = [
    (2020, 0.2727272727272727, 0.5272727272727272, 0.2),
    (2021, 0.24742268041237114, 0.39690721649484534, 0.3556701030927835),
    (2022, 0.3617511520737327, 0.35714285714285715, 0.28110599078341014),
    (2023, 0.3287142208087233, 0.28850522489777375, 0.38278055429350294),
    (2024, 0.3960119156179707, 0.33418444890266885, 0.2698036354793604),
    (2025, 0.3885899649291228, 0.346876524189615, 0.26453351088126226),
]
VADER_YEARLY = [
    (2020, 0.2, 0.18181818181818182, 0.6181818181818182),
    (2021, 0.17525773195876287, 0.22164948453608246, 0.6030927835051546),
    (2022, 0.29493087557603687, 0.195852534562212, 0.5092165898617511),
    (2023, 0.24875056792367106, 0.17060427078600637, 0.5806451612903226),
    (2024, 0.2894096905586966, 0.19554380205483615, 0.5150465073864673),
    (2025, 0.3054495343237824, 0.18392468664596995, 0.5106257790302476),
]


def test_golden_trend_slopes(spark):
    b = spark.createDataFrame(BERT_YEARLY, "year int, negative double, neutral double, positive double")
    got = {r["label"]: r for r in TR.label_trends(b).collect()}
    assert abs(got["negative"]["slope"] - 0.0283441) < 1e-6
    assert abs(got["negative"]["r_squared"] - 0.74543) < 1e-5
    assert abs(got["positive"]["slope"] - 0.0047641) < 1e-6
    assert abs(got["positive"]["r_squared"] - 0.01795) < 1e-5
    assert got["negative"]["direction"] == "increasing"
    v = spark.createDataFrame(VADER_YEARLY, "year int, negative double, neutral double, positive double")
    gv = {r["label"]: r["slope"] for r in TR.label_trends(v).collect()}
    assert abs(gv["positive"] + 0.0208712) < 1e-6 and abs(gv["negative"] - 0.0235292) < 1e-6


# Golden pair: yearly topic shares (first and last year are what the change uses).
TOPIC_2020 = [0.0, 0.1875, 0.1875, 0.0, 0.0, 0.0625, 0.0, 0.5, 0.0625]
TOPIC_2025 = [0.10502024082716654, 0.12626666322873423, 0.14676533532733413, 0.01567697186911791,
              0.07155196864605626, 0.09424232266714798, 0.10378258515328881, 0.2349740865843282,
              0.10171982569682593]


def test_golden_topic_gain_loss(spark):
    rows = [(2020, t, s) for t, s in enumerate(TOPIC_2020)] + [(2025, t, s) for t, s in enumerate(TOPIC_2025)]
    ty = spark.createDataFrame(rows, "year int, topic int, share double")
    gl = TR.gain_loss_top(TR.topic_change(ty)).collect()
    gain = [(r["topic"], round(r["change"], 5)) for r in gl if r["side"] == "gaining"]
    lose = [(r["topic"], round(r["change"], 5)) for r in gl if r["side"] == "losing"]
    exp_gain = [(0, 0.10502), (6, 0.10378), (4, 0.07155)]
    exp_lose = [(1, -0.06123), (2, -0.04074), (7, -0.26503)]
    assert [t for t, _ in gain] == [t for t, _ in exp_gain]
    assert sorted(t for t, _ in lose) == [t for t, _ in exp_lose]
    got = dict(gain + lose)
    for t, v in exp_gain + exp_lose:
        assert abs(got[t] - v) < 1e-4


def _pc(spark, rows):
    return spark.createDataFrame(rows, "post_id string, ord int, comment_id int, bert_label string")


def test_post_comment_pairs_first_row_and_nulls(spark):
    rows = [("p1", 2, 1, "negative"), ("p1", 1, 2, "positive"), ("p1", 1, 3, "negative"),
            ("p2", 1, 4, None), ("p3", 5, 5, "neutral")]
    pairs = {r["post_id"]: r for r in CT.post_comment_pairs(_pc(spark, rows), "bert_label", ["ord", "comment_id"]).collect()}
    assert pairs["p1"]["post_label"] == "positive" and pairs["p1"]["post_score"] == 1
    assert abs(pairs["p1"]["avg_comment_score"] - (-1 / 3)) < 1e-12
    assert pairs["p2"]["post_score"] == 0 and pairs["p2"]["avg_comment_score"] == 0.0
    assert pairs["p3"]["n_comments"] == 1


def test_correlation_needs_more_than_ten_posts(spark):
    def frame(n):
        rows = []
        for i in range(n):
            lab = ["positive", "negative", "neutral"][i % 3]
            rows += [(f"p{i}", 0, 2 * i, lab), (f"p{i}", 1, 2 * i + 1, ["negative", "positive"][i % 2])]
        return _pc(spark, rows)
    r10 = CT.post_comment_correlation(CT.post_comment_pairs(frame(10), "bert_label", ["ord"])).first()
    r11 = CT.post_comment_correlation(CT.post_comment_pairs(frame(11), "bert_label", ["ord"])).first()
    assert r10["r"] is None and r11["r"] is not None and r11["p_value"] is not None


def test_alignment_bins_right_closed(spark):
    pairs = spark.createDataFrame([(-1, -0.5), (0, 0.5), (1, 0.5000001), (1, 2.5)],
                                  "post_score int, avg_comment_score double")
    got = {(r["post_cat"], r["comment_cat"]): r["n"] for r in CT.alignment_matrix(pairs).collect()}
    assert got == {("Negative", "Negative"): 1, ("Neutral", "Neutral"): 1, ("Positive", "Positive"): 1}


def test_agreement_perfect_and_missing_class(spark):
    same = spark.createDataFrame([("positive", "positive"), ("negative", "negative"), (None, "neutral")], "a string, b string")
    assert AG.cohen_kappa(same, "a", "b").first()["kappa"] == 1.0
    assert AG.agreement_rate(same, "a", "b").first()["agreement"] == 1.0
    mixed = spark.createDataFrame([("positive", "negative"), ("negative", "negative"), ("neutral", "negative")], "a string, b string")
    rep = {r["class"]: r for r in AG.class_report(mixed, "a", "b").collect()}
    assert rep["positive"]["precision"] == 0.0 and rep["negative"]["recall"] == 1.0
    assert abs(rep["accuracy"]["f1"] - 1 / 3) < 1e-12
    cm = {r["label_a"]: (r["n_negative"], r["n_neutral"], r["n_positive"]) for r in AG.confusion_counts(mixed, "a", "b").collect()}
    assert cm == {"negative": (1, 0, 0), "neutral": (1, 0, 0), "positive": (1, 0, 0)}


def test_users_null_and_tie_at_cutoff(spark):
    df = spark.createDataFrame([(None, 1, 0, "alpha beta beta"), ("u1", 1, 1, "gamma"), ("u2", 2, 1, "delta"),
                                ("u2", 2, None, "delta delta"), ("u3", 3, 0, "zeta")],
                               "user string, topic int, subtopic int, text string")
    top = US.top_users(df, "user", 2).collect()
    assert [(r["user"], r["n_posts"]) for r in top] == [("u2", 2), ("UNKNOWN", 1)]
    prof = {r["user"]: r for r in US.top_users_profile(df, "user", "topic", "subtopic", "text", 2, 5).collect()}
    assert prof["UNKNOWN"]["top_words"] == "beta:2;alpha:1"
    assert prof["u2"]["subtopic_dist"] == {"1": 1.0} and prof["u2"]["topic_dist"] == {"2": 1.0}


def test_histogram_bins_closed_last(spark):
    v = spark.createDataFrame([(1,), (2,), (3,), (3,)], "x int")
    h = {r["bin"]: r["n"] for r in D.histogram(v, "x", 2).collect()}
    assert h == {0: 1, 1: 3}
    same = spark.createDataFrame([(5,), (5,)], "x int")
    hs = D.histogram(same, "x", 2).orderBy("bin").collect()
    assert [r["n"] for r in hs] == [0, 2] and hs[0]["bin_start"] == 4.5


def test_post_text_mode(spark):
    rows = [("p1", 1, 1, "negative", "positive"), ("p1", 2, 2, "negative", "positive"), ("p2", 1, 3, "positive", None)]
    df = spark.createDataFrame(rows, "post_id string, ord int, comment_id int, bert_label string, post_lab string")
    got = {r["post_id"]: (r["post_score"], r["avg_comment_score"]) for r in
           CT.post_comment_pairs(df, "bert_label", ["ord"], mode="post_text", post_label_col="post_lab").collect()}
    assert got == {"p1": (1, -1.0), "p2": (0, 1.0)}
    with pytest.raises(ValueError):
        CT.post_comment_pairs(df, "bert_label", ["ord"], mode="post_text")
