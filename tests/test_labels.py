from threadlens.functions.labels import compound_label, normalize_model_label, polarity, topic_subtopic_key


def test_compound_label_thresholds(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,), (None,)], "c double")
    assert [r[0] for r in df.select(compound_label("c")).collect()] == ["positive", "negative", "neutral", "neutral"]


def test_normalize_model_label(spark):
    vals = ["NEGATIVE", "Positive", "neu", "LABEL_0", "LABEL_1", "label_2", "Other", None]
    df = spark.createDataFrame([(v,) for v in vals], "l string")
    got = [r[0] for r in df.select(normalize_model_label("l")).collect()]
    assert got == ["negative", "positive", "neutral", "negative", "neutral", "positive", "other", None]


def test_polarity_and_key(spark):
    df = spark.createDataFrame([("positive", 1, 2), ("negative", 3, 0), (None, 0, 1)], "l string, t int, s int")
    assert [r[0] for r in df.select(polarity("l")).collect()] == [1, -1, 0]
    assert [r[0] for r in df.select(topic_subtopic_key("t", "s")).collect()] == ["T1-S2", "T3-S0", "T0-S1"]
