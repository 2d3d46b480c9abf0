"""The registered coherence query (E3) over a word table that both engines derive: each language's
six most frequent tokens are a topic."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.coherence import EPSILON, coherence_cv_per_topic
from ..operators.common import materialize
from .registry import finish, register
from .textual import TOKS, doc_tokens

WINDOW, WORDS = 110, 6


@register("coherence_fixed_words", f"""WITH {TOKS},
n AS (SELECT doc_id, lang, t, greatest(len(t) - {WINDOW} + 1, 1) AS nw FROM toks),
f AS (SELECT lang, term, count(*) AS c FROM (SELECT lang, unnest(t) AS term FROM toks) GROUP BY ALL),
r AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY c DESC, term) AS r FROM f),
tw AS (SELECT dense_rank() OVER (ORDER BY lang) - 1 AS topic, term FROM r WHERE r <= {WORDS}),
o AS (SELECT doc_id, nw, p, term FROM (SELECT doc_id, nw, unnest(t) AS term, unnest(range(len(t))) AS p FROM n)
      WHERE term IN (SELECT term FROM tw)),
w AS (SELECT DISTINCT doc_id, term, unnest(range(greatest(0, p - {WINDOW} + 1), least(p, nw - 1) + 1)) AS s FROM o),
total AS (SELECT sum(nw)::DOUBLE AS n FROM (SELECT DISTINCT doc_id, nw FROM o)),
c1 AS (SELECT term, count(*) AS c FROM w GROUP BY 1),
c2 AS (SELECT x.term AS a, y.term AS b, count(*) AS c FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.s = y.s GROUP BY ALL),
g AS (SELECT x.topic, x.term AS a, y.term AS b, coalesce(c2.c, 0) / n AS pab, ca.c / n AS pa, cb.c / n AS pb
      FROM tw x JOIN tw y ON x.topic = y.topic LEFT JOIN c2 ON c2.a = x.term AND c2.b = y.term
           JOIN c1 ca ON ca.term = x.term JOIN c1 cb ON cb.term = y.term CROSS JOIN total),
s AS (SELECT topic, a, b, ln((pab + {EPSILON}) / (pa * pb)) / -ln(pab + {EPSILON}) AS v FROM g),
sw AS (SELECT topic, b, sum(v) AS vw FROM s GROUP BY ALL),
cs AS (SELECT s.topic, s.a, sum(v * vw) / (sqrt(sum(v * v)) * sqrt(sum(vw * vw))) AS c
       FROM s JOIN sw ON sw.topic = s.topic AND sw.b = s.b GROUP BY ALL)
SELECT CAST(topic AS INTEGER) AS topic, round(avg(c), 6) AS coherence FROM cs GROUP BY 1""")
def q_coherence_fixed_words(spark, sf):
    """c_v of given topics."""
    t = doc_tokens(spark, sf, materialized=True)
    counts = t.select("lang", F.explode("tokens").alias("term")).groupBy("lang", "term").agg(F.count(F.lit(1)).alias("c"))
    top = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "term"))).where(
        F.col("r") <= WORDS)
    # A number for each of the few languages.
    langs = top.select("lang").distinct().withColumn("topic", (F.row_number().over(Window.orderBy("lang")) - 1).cast("int"))
    words = materialize(top.join(langs, "lang").select("topic", "term"))
    return finish(coherence_cv_per_topic(t, words, "tokens", WINDOW))
