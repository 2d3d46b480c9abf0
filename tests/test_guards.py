"""Guard paths: L2 without a user column, C9 empty vocabulary, E2 k range, E6 empty docs."""

import pytest

from threadlens.operators import topics as TP
from threadlens.operators.users import empty_profile
from threadlens.operators.vocab import require_vocabulary


def test_empty_profile_schema(spark):
    df = empty_profile(spark)
    assert df.count() == 0
    assert df.columns == ["user", "n_posts", "topic_dist", "subtopic_dist", "top_words"]


def test_empty_vocabulary_raises():
    with pytest.raises(ValueError):
        require_vocabulary([])


def test_k_range_bounds():
    assert TP.k_range(1000) == list(range(3, 11))
    assert TP.k_range(9) == [3, 4]
    assert TP.k_range(5) == []


def test_k_search_needs_a_range(spark):
    d = spark.createDataFrame([(0, ["a"])], "doc_id int, tokens array<string>")
    with pytest.raises(ValueError):
        TP.k_search(d, d, d, [], 1)


def test_dominant_topic_empty_modes(spark):
    th = spark.createDataFrame([(1, [0.0, 0.0, 0.0]), (2, [0.2, 0.5, 0.3]), (3, [0.4, 0.2, 0.4])],
                               "doc_id int, theta array<double>")
    first = {r["doc_id"]: (r["topic_id"], r["topic_strength"]) for r in TP.dominant_topic(th, "doc_id", 3).collect()}
    assert first[1] == (0, pytest.approx(1 / 3)) and first[2] == (1, 0.5) and first[3] == (0, 0.4)
    null = {r["doc_id"]: (r["topic_id"], r["topic_strength"])
            for r in TP.dominant_topic(th, "doc_id", 3, empty="null").collect()}
    assert null[1] == (None, 0.0)
