"""A8-A10, B5, G8 corpus assembly and M1/M2 streaming on small frames."""

import datetime as dt

from pyspark.sql import functions as F

from threadlens.sources import collect as CO
from threadlens.streaming import live as LV


def test_keyword_query_and_hits(spark):
    assert CO.keyword_query(["hot flashes", "HRT", "sleep"]) == '"hot flashes" OR HRT OR sleep'
    df = spark.createDataFrame([("Hot flashes and hrt",), ("shortHRT",), (None,)], "t string")
    assert [r[0] for r in df.select(CO.keyword_hits("t", ["hot flashes", "HRT"])).collect()] == [2, 0, 0]


def _posts(spark):
    rows = [("p1", "A", 5, 1), ("p2", "A", 9, 0), ("p3", "a", 1, 3), ("p4", "B", 7, 0)]
    return spark.createDataFrame(rows, "post_id string, src string, score int, hits int")


def test_assemble_first_seen_and_counters(spark):
    measures = {"relevance": [F.desc("hits"), F.asc("post_id")], "top": [F.desc("score"), F.asc("post_id")]}
    sel = CO.assemble(_posts(spark), "post_id", "src", 1, measures, ["relevance", "top"])
    got = {r["post_id"]: (r["src"], r["method"], r["rank"], r["dup_count"]) for r in sel.collect()}
    # per source (case kept) top-1 by relevance then by score; p3 wins relevance in "a"
    assert got == {"p1": ("A", "relevance", 1, 0), "p3": ("a", "relevance", 1, 1),
                   "p4": ("B", "relevance", 1, 1), "p2": ("A", "top", 1, 0)}
    comments = spark.createDataFrame([("p1", "x"), ("p1", None), ("p4", "y")], "post_id string, body string")
    flat = CO.flatten(sel, comments, "post_id", "body")
    assert sorted(r["post_id"] for r in flat.collect()) == ["p1", "p4"]
    c = {(r["src"], r["method"]): r for r in CO.counters(sel, comments, "post_id", "src", "body").collect()}
    assert c[("A", "relevance")]["comments_kept"] == 1 and c[("A", "top")]["posts_with_comments"] == 0
    seen = spark.createDataFrame([("p1",)], "post_id string")
    assert sorted(r[0] for r in CO.skip_seen(sel.select("post_id"), seen, "post_id").collect()) == ["p2", "p3", "p4"]


def test_streams_match_batch(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 1), 7, "view"), (2, dt.datetime(2024, 1, 1, 5), 7, "view"),
            (3, dt.datetime(2024, 1, 2, 3), 8, "click"), (4, dt.datetime(2024, 1, 2, 4), 7, "view")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string")
    src = str(tmp_path / "events")
    df.write.parquet(src)
    shares = LV.stream_window_shares(spark, src, df.schema, "ts", "event_type")
    got = {(str(r["window_start"]), r["label"]): (r["n"], r["share"]) for r in shares.collect()}
    assert got == {("2024-01-01 00:00:00", "view"): (2, 1.0), ("2024-01-02 00:00:00", "click"): (1, 0.5),
                   ("2024-01-02 00:00:00", "view"): (1, 0.5)}
    first = LV.stream_first_seen(spark, src, df.schema, "ts", ["user_id", "event_type"])
    assert sorted((r["user_id"], r["event_type"]) for r in first.collect()) == [(7, "view"), (8, "click")]


def test_stream_state_is_dropped_behind_the_watermark(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    src = str(tmp_path / "ev")
    for i, day in enumerate((1, 2, 25, 28)):
        spark.createDataFrame([(i, dt.datetime(2024, 1, day, 1), 7, "view")], schema).coalesce(1) \
             .write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    rows = []
    q = (LV.window_shares(s, "ts", "event_type", "1 day", "2 days").writeStream.outputMode("update")
         .foreachBatch(lambda b, i: rows.extend((i, r.n) for r in b.collect()))
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    state = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert sum(n for _, n in rows) == 4 and max(state) >= 2 and state[-1] < 4
    shares = LV.stream_window_shares(spark, src, spark.read.parquet(src).schema, "ts", "event_type")
    assert shares.count() == 4
