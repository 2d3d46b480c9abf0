"""Resolver, defaults, time coercion, sinks, pluggable scorer."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from threadlens.columns import (TIME_CANDIDATES, first_existing, require_columns, require_one,
                                with_default)
from threadlens.functions.timeaxis import coerce_time, month_start
from threadlens.operators.sentiment import score_with_udf_model
from threadlens.operators.text_ops import raw_text_fields
from threadlens.sources import io as IO


def test_resolver_and_required(spark):
    df = spark.createDataFrame([(1, 2.0)], "post_created_utc int, created double")
    assert first_existing(df, TIME_CANDIDATES) == "post_created_utc"
    assert first_existing(df, ["nope"]) is None
    with pytest.raises(ValueError):
        require_one(df, ["a", "b"], "topic")
    with pytest.raises(ValueError):
        require_columns(df, ["created", "missing"])


def test_defaults_and_fallbacks(spark):
    df = spark.createDataFrame([("t1", "body")], "topic string, comment_body string")
    out = with_default(with_default(with_default(df, "comment_subtopic", -1), "topic_id", None, ["topic"]),
                       "comment_text_lem", "", ["comment_body"])
    r = out.first()
    assert r["comment_subtopic"] == -1 and r["topic_id"] == "t1" and r["comment_text_lem"] == "body"


def test_coerce_time_by_type(spark):
    df = spark.createDataFrame([(1577836800.0, "2021-03-04 05:06:07", "garbage")], "u double, s string, b string")
    r = df.select(coerce_time(df, "u").alias("u"), coerce_time(df, "s").alias("s"),
                  coerce_time(df, "b").alias("b")).first()
    assert r["u"] == dt.datetime(2020, 1, 1) and r["s"] == dt.datetime(2021, 3, 4, 5, 6, 7) and r["b"] is None
    m = df.select(month_start(coerce_time(df, "s")).alias("m")).first()["m"]
    assert m == dt.date(2021, 3, 1)


def test_raw_fields_rules(spark):
    df = spark.createDataFrame([(None, "  body ", None), ("Title", None, "  "), ("T", "B", "hi")],
                               "post_title string, post_body string, comment_body string")
    rows = raw_text_fields(df).collect()
    assert [r["post_text_raw"] for r in rows] == ["body", "Title", "T B"]
    assert [r["text_raw"] for r in rows] == ["body", "Title", "hi"]


def test_csv_and_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p1", 'said "hi"\nthen left', 3)], "post_id string, comment_body string, n long")
    p = str(tmp_path / "csv")
    IO.write_csv(df, p)
    back = IO.read_csv(spark, p, df.schema).first()
    assert back["comment_body"] == 'said "hi"\nthen left' and back["n"] == 3
    j = str(tmp_path / "json")
    IO.write_json(df, j)
    assert spark.read.json(j).first()["post_id"] == "p1"
    s = IO.as_json(df, ["post_id", "n"]).first()["json"]
    assert json.loads(s) == {"post_id": "p1", "n": 3}


def test_pluggable_scorer(spark):
    def load():
        def scorer(texts):
            return [("LABEL_2" if "good" in t else "NEG", 0.9) for t in texts]
        return scorer
    df = spark.createDataFrame([(1, "good day"), (2, "awful"), (3, "  ")], "id int, text string")
    got = {r["id"]: (r["bert_label"], r["bert_score"]) for r in score_with_udf_model(df, "text", load, 2).collect()}
    assert got == {1: ("positive", 0.9), 2: ("negative", 0.9), 3: ("negative", 0.9)}


def test_random_row_is_seeded(spark):
    df = spark.range(100)
    a = df.orderBy(F.rand(42)).limit(1).first()[0]
    b = df.orderBy(F.rand(42)).limit(1).first()[0]
    assert a == b
