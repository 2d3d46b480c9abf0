"""Driver contract: entry smoke test and a DuckDB oracle sample at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and df.columns == ["year", "negative", "neutral", "positive"]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 80


SAMPLE = ["label_share_by_year_b", "post_summary_by_topic", "class_report", "post_comment_corr",
          "top_users_profile", "clean_text", "phrase_merge", "lexicon_sentiment_l0", "vocab_df_bounds",
          "collect_counters", "user_histogram", "stream_first_seen"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_oracle_sample(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = sdf.collect()
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert rows_of(sdf.columns, srows) == rows_of(dcols, drows)
