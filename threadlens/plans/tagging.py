"""The registered tagging query (C2) and its oracle, a recursion over each sentence's words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.stopwords import NLTK_ENGLISH
from ..operators import tagger as TG
from ..sources.tables import docs
from .registry import register
from .textual import clean_sql, sql_list


def _sql() -> str:
    g, n = TG.Grammar(), len(TG.TAGS)

    def score(tag: str) -> str:
        ends = "".join(f" + CASE WHEN ends_with(w, '{e}') THEN {x}::DOUBLE ELSE 0.0::DOUBLE END" for e, t, x in g.endings if t == tag)
        return f"({g.prior[tag]}::DOUBLE{ends})"

    own = " ".join(f"WHEN '{w}' THEN {[float(x) for x in s]}::DOUBLE[]" for w, s in g.words)
    emit = f"CASE w {own} ELSE [{', '.join(score(t) for t in TG.TAGS)}] END"
    into = [f"[score[i] + ({[float(g.follows[i][j]) for i in range(n)]}::DOUBLE[])[i] FOR i IN range(1, {n + 1})]" for j in range(n)]
    rules = " ".join(f"WHEN tag = {TG.TAGS.index(t)} AND ends_with(word, '{e}') AND length(word) >= {least} "
                     f"THEN word[:length(word) - {len(e)}] || '{new}'" for t, e, new, least in g.rewrite)
    known = " ".join(f"WHEN word = '{w}' AND tag = {TG.TAGS.index(t)} THEN '{lemma}'" for w, t, lemma in g.irregular)
    start = f"{[float(x) for x in g.start]}::DOUBLE[]"
    return f"""WITH RECURSIVE p AS (
  SELECT doc_id, unnest(string_split_regex(lower({clean_sql('text')}), '[.!?]+')) AS s,
         unnest(range(len(string_split_regex(lower({clean_sql('text')}), '[.!?]+')))) AS sid FROM documents),
t AS (SELECT doc_id, sid, regexp_extract_all(s, '[a-z]+') AS words FROM p WHERE len(regexp_extract_all(s, '[a-z]+')) > 0),
e AS (SELECT doc_id, sid, words, [{emit} FOR w IN words] AS em FROM t),
v AS (
  SELECT doc_id, sid, 1 AS i, [({start})[k] + em[1][k] FOR k IN range(1, {n + 1})] AS score, []::BIGINT[][] AS back FROM e
  UNION ALL
  SELECT doc_id, sid, i + 1, [{', '.join(f'list_max({x}) + em[i + 1][{j + 1}]' for j, x in enumerate(into))}],
         list_append(back, [{', '.join(f'list_position({x}, list_max({x}))' for x in into)}]::BIGINT[])
  FROM v JOIN e USING (doc_id, sid) WHERE i < len(words)),
f AS (SELECT v.* FROM v JOIN e USING (doc_id, sid) WHERE i = len(words)),
b AS (
  SELECT doc_id, sid, i, back, CAST(list_position(score, list_max(score)) AS BIGINT) AS tag FROM f
  UNION ALL SELECT doc_id, sid, i - 1, back, back[i - 1][tag] FROM b WHERE i > 1),
w AS (SELECT doc_id, sid, i, words[i] AS word, tag - 1 AS tag FROM b JOIN e USING (doc_id, sid)),
l AS (SELECT *, CASE {known} {rules} ELSE word END AS lemma FROM w)
SELECT d.doc_id, coalesce(string_agg(lemma, ' ' ORDER BY sid, i) FILTER (NOT list_contains({sql_list(NLTK_ENGLISH)}, word)), '') AS text_lem,
       {', '.join(f"CAST(count(*) FILTER (tag = {i}) AS BIGINT) AS n_{t}" for i, t in enumerate(TG.TAGS))}
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id GROUP BY 1"""


@register("lemma_tagged", _sql())
def q_lemma_tagged(spark, sf):
    """Lemmas by part of speech, and how many words of each there are."""
    d = docs(spark, sf).select("doc_id", TX.clean_text("text").alias("text_clean"))
    tags = F.transform("tagged", lambda p: p["tag"])

    def count(tag: str):
        return F.size(F.filter(tags, lambda t: t == tag)).cast("long").alias(f"n_{tag}")

    return TG.lemma_tagged(d, "text_clean").select("doc_id", "text_lem", *[count(t) for t in TG.TAGS])
