"""Registered queries of the topic view (E9) over term counts that both engines derive: the
topics are language and source groups of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import topic_map as TM
from ..operators.common import attach_scalars, materialize
from ..sources.tables import docs
from .registry import finish, register

_COUNTS = """WITH RECURSIVE c AS (
  SELECT topic, term, count(*) AS n
  FROM (SELECT lang || '/' || (doc_id % 3) AS topic, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term
        FROM documents) GROUP BY 1, 2),
t AS (SELECT topic, sum(n) AS total FROM c GROUP BY 1),
phi AS (SELECT c.topic, c.term, c.n / t.total AS phi FROM c JOIN t ON c.topic = t.topic),
js AS (
  SELECT a.topic AS a, b.topic AS b, greatest(0, 0.5 * (
    coalesce((SELECT sum(p.phi * ln(2 * p.phi / (p.phi + coalesce(q.phi, 0))))
              FROM phi p LEFT JOIN phi q ON q.topic = b.topic AND q.term = p.term WHERE p.topic = a.topic), 0)
    + coalesce((SELECT sum(q.phi * ln(2 * q.phi / (q.phi + coalesce(p.phi, 0))))
                FROM phi q LEFT JOIN phi p ON p.topic = a.topic AND p.term = q.term WHERE q.topic = b.topic), 0))) AS jsd
  FROM t a JOIN t b ON a.topic < b.topic)
"""


def _counts(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    topic = F.concat_ws("/", "lang", (F.col("doc_id") % 3).cast("string"))
    return (docs(spark, sf).select(topic.alias("topic"), F.explode(words).alias("term"))
            .groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n")))


def _phi(counts):
    total = counts.groupBy("topic").agg(F.sum("n").alias("_t"))
    return counts.join(total, "topic").select("topic", "term", (F.col("n") / F.col("_t")).alias("phi"))


@register("topic_divergence", _COUNTS + "SELECT a, b, round(jsd, 6) AS jsd FROM js")
def q_topic_divergence(spark, sf):
    """Jensen-Shannon divergence of every two topics' term distributions."""
    return finish(TM.js_divergence(_phi(materialize(_counts(spark, sf)))))


# The layout once more, by plain power iteration over matrices as lists.
_AXES = _COUNTS + """, full_d AS (
  SELECT a, b, jsd FROM js UNION ALL SELECT b, a, jsd FROM js UNION ALL SELECT topic, topic, 0 FROM t),
rowsd AS (SELECT a, list(jsd * jsd ORDER BY b) AS r FROM full_d GROUP BY a),
mat AS (SELECT list(a ORDER BY a) AS topics, list(r ORDER BY a) AS d, CAST(count(*) AS INTEGER) AS k FROM rowsd),
mean AS (SELECT *, [list_sum(r) / k FOR r IN d] AS mu FROM mat),
m0 AS (SELECT topics, k, [[(d[i][j] - mu[i] - mu[j] + list_sum(mu) / k) / -2 FOR j IN range(1, k + 1)] FOR i IN range(1, k + 1)] AS m
       FROM mean),
s0 AS (SELECT topics, k, m, [[m[i][j] + CASE WHEN i = j THEN list_max([list_sum([abs(x) FOR x IN r]) FOR r IN m]) ELSE 0 END
              FOR j IN range(1, k + 1)] FOR i IN range(1, k + 1)] AS s FROM m0),
p0 AS (SELECT 0 AS step, topics, k, m, s FROM s0
  UNION ALL SELECT step + 1, topics, k, m, [[x / list_max([list_max([abs(y) FOR y IN q]) FOR q IN s2]) FOR x IN r] FOR r IN s2]
  FROM (SELECT step, topics, k, m, [[list_sum([s[i][l] * s[j][l] FOR l IN range(1, k + 1)]) FOR j IN range(1, k + 1)]
                                    FOR i IN range(1, k + 1)] AS s2 FROM p0 WHERE step < 40)),
u0 AS (SELECT topics, k, m, list_max([[sqrt(list_sum([x * x FOR x IN r]))] || r FOR r IN s])[2:] AS r FROM p0 WHERE step = 40),
n0 AS (SELECT topics, k, m, [x / sqrt(list_sum([y * y FOR y IN r])) FOR x IN r] AS v FROM u0),
v0 AS (SELECT topics, k, m, [x * CASE WHEN list_max(v) >= -list_min(v) - 1e-9 THEN 1 ELSE -1 END FOR x IN v] AS v FROM n0),
w0 AS (SELECT *, list_sum([list_sum([m[i][j] * v[j] FOR j IN range(1, k + 1)]) * v[i] FOR i IN range(1, k + 1)]) AS w FROM v0),
m1 AS (SELECT topics, k, v AS vx, w AS wx, [[m[i][j] - w * v[i] * v[j] FOR j IN range(1, k + 1)] FOR i IN range(1, k + 1)] AS m FROM w0),
s1 AS (SELECT topics, k, vx, wx, m, [[m[i][j] + CASE WHEN i = j THEN list_max([list_sum([abs(x) FOR x IN r]) FOR r IN m]) ELSE 0 END
              FOR j IN range(1, k + 1)] FOR i IN range(1, k + 1)] AS s FROM m1),
p1 AS (SELECT 0 AS step, topics, k, vx, wx, m, s FROM s1
  UNION ALL SELECT step + 1, topics, k, vx, wx, m, [[x / list_max([list_max([abs(y) FOR y IN q]) FOR q IN s2]) FOR x IN r] FOR r IN s2]
  FROM (SELECT step, topics, k, vx, wx, m, [[list_sum([s[i][l] * s[j][l] FOR l IN range(1, k + 1)]) FOR j IN range(1, k + 1)]
                                            FOR i IN range(1, k + 1)] AS s2 FROM p1 WHERE step < 40)),
u1 AS (SELECT topics, k, vx, wx, m, list_max([[sqrt(list_sum([x * x FOR x IN r]))] || r FOR r IN s])[2:] AS r FROM p1 WHERE step = 40),
n1 AS (SELECT topics, k, vx, wx, m, [x / sqrt(list_sum([y * y FOR y IN r])) FOR x IN r] AS v FROM u1),
v1 AS (SELECT topics, k, vx, wx, m, [x * CASE WHEN list_max(v) >= -list_min(v) - 1e-9 THEN 1 ELSE -1 END FOR x IN v] AS v FROM n1),
w1 AS (SELECT *, list_sum([list_sum([m[i][j] * v[j] FOR j IN range(1, k + 1)]) * v[i] FOR i IN range(1, k + 1)]) AS w FROM v1),
place AS (SELECT unnest(topics) AS topic, unnest([x * sqrt(greatest(wx, 0)) FOR x IN vx]) AS x,
                 unnest([x * sqrt(greatest(w, 0)) FOR x IN v]) AS y FROM w1)
SELECT place.topic, round(x, 6) AS x, round(y, 6) AS y, round(total / (SELECT sum(total) FROM t), 6) AS share,
       CAST(row_number() OVER (ORDER BY total DESC, place.topic) AS INTEGER) AS rank
FROM place JOIN t ON t.topic = place.topic
"""


@register("topic_map", _AXES)
def q_topic_map(spark, sf):
    """Two coordinates a topic, its share and its rank."""
    counts = materialize(_counts(spark, sf))
    return finish(TM.topic_map(_phi(counts), counts.groupBy("topic").agg(F.sum("n").alias("n"))))


@register("topic_map_residual", "SELECT true AS solved, true AS in_order")
def q_topic_map_residual(spark, sf):
    """The coordinates solve the eigenvalue equation, and the first axis carries at least as much as the second."""
    place = TM.layout(TM.js_divergence(_phi(materialize(_counts(spark, sf)))))
    return place.agg((F.max("residual") < 1e-9).alias("solved"),
                     (F.sum(F.col("x") * F.col("x")) >= F.sum(F.col("y") * F.col("y"))).alias("in_order"))


@register("topic_saliency", _COUNTS + """, p AS (SELECT topic, total / sum(total) OVER () AS p_t FROM t),
f AS (SELECT term, sum(n) AS freq FROM c GROUP BY 1),
d AS (SELECT c.term, greatest(0, sum(c.n / f.freq * ln(c.n / f.freq / p.p_t))) AS distinctiveness
      FROM c JOIN f ON f.term = c.term JOIN p ON p.topic = c.topic GROUP BY 1)
SELECT d.term, CAST(f.freq AS BIGINT) AS freq, round(distinctiveness, 6) AS distinctiveness,
       round(f.freq / (SELECT sum(n) FROM c) * distinctiveness, 6) AS saliency
FROM d JOIN f ON f.term = d.term""")
def q_topic_saliency(spark, sf):
    """Saliency and distinctiveness of every term."""
    return finish(TM.saliency(materialize(_counts(spark, sf))))
