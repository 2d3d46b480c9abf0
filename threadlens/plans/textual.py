"""Registered text queries over the ``documents`` / ``conversations`` bindings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as TX
from ..functions.lexicon import DEFAULT_LEXICON
from ..functions.stopwords import NLTK_ENGLISH, topic_stopwords
from ..operators import phrases as PH
from ..operators import sentiment as SE
from ..operators import text_ops as TO
from ..operators import vocab as VO
from ..operators.common import materialize
from ..sources.tables import conv_raw, docs
from .registry import finish, register


def re2(pattern: str) -> str:
    """Java pattern -> DuckDB (RE2) literal body: drop the Unicode flag (in RE2 ``U``
    means ungreedy) and double single quotes."""
    return pattern.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _rx(expr: str, pattern: str, repl: str = "") -> str:
    return f"regexp_replace({expr}, '{re2(pattern)}', '{repl}', 'g')"


def clean_sql(expr: str) -> str:
    s = f"coalesce({expr}, '')"
    for p in (TX.HANDLE_PATTERN, TX.EMAIL_PATTERN, TX.PHONE_PATTERN, TX.HONORIFIC_PATTERN,
              TX.URL_PATTERN, TX.EMOJI_PATTERN):
        s = _rx(s, p)
    s = f"replace(replace({s}, chr(10), ' '), chr(13), ' ')"
    s = _rx(s, TX.WHITELIST_PATTERN, " ")
    return f"trim({_rx(s, TX.SPACE_RUN_PATTERN, ' ')})"


def topic_clean_sql(expr: str) -> str:
    s = _rx(f"coalesce({expr}, '')", TX.URL_PATTERN)
    s = _rx(s, r"[^A-Za-z\s]", " ")
    return f"lower(trim({_rx(s, TX.SPACE_RUN_PATTERN, ' ')}))"


def tokens_sql(expr: str) -> str:
    toks = f"list_filter(regexp_extract_all({topic_clean_sql(expr)}, '[a-z]+'), lambda x: length(x) BETWEEN 2 AND 15)"
    return f"list_filter({toks}, lambda x: NOT list_contains({sql_list(topic_stopwords())}, x))"


TOKS = f"toks AS (SELECT doc_id, lang, {tokens_sql('text')} AS t FROM documents)"


def doc_tokens(spark, sf, materialized: bool = False):
    t = TO.topic_tokens(docs(spark, sf), "text")
    return materialize(t.select("doc_id", "lang", "tokens")) if materialized else t


# ------------------------------------------------------------------ C1 / C1a-h / C3

@register("clean_text", f"SELECT doc_id, {clean_sql('text')} AS text_clean FROM documents")
def q_clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", TX.clean_text("text").alias("text_clean"))


_STEPS = [("handles", TX.HANDLE_PATTERN), ("emails", TX.EMAIL_PATTERN), ("phones", TX.PHONE_PATTERN),
          ("honorifics", TX.HONORIFIC_PATTERN), ("urls", TX.URL_PATTERN), ("emoji", TX.EMOJI_PATTERN),
          ("non_whitelist", TX.WHITELIST_PATTERN)]


def _steps_sql():
    cur = "coalesce(text, '')"
    cols = []
    for name, p in _STEPS:
        if name == "non_whitelist":
            cur = f"replace(replace({cur}, chr(10), ' '), chr(13), ' ')"
        cols.append(f"len(regexp_extract_all({cur}, '{re2(p)}')) AS {name}")
        cur = _rx(cur, p, " " if name == "non_whitelist" else "")
    unions = " UNION ALL ".join(
        f"SELECT '{n}' AS step, CAST(count(*) FILTER (WHERE {n} > 0) AS BIGINT) AS n_docs, "
        f"CAST(sum({n}) AS BIGINT) AS n_matches FROM m" for n, _ in _STEPS)
    return f"WITH m AS (SELECT {', '.join(cols)} FROM documents) {unions}"


@register("clean_steps_counts", _steps_sql())
def q_clean_steps_counts(spark, sf):
    """C1a-C1g applied in order; per step, documents hit and matches removed."""
    # One step after the other, so that a step's text is made once for its count and the next step.
    m = docs(spark, sf).select(F.coalesce(F.col("text"), F.lit("")).alias("cur"))
    done = []
    for name, p in _STEPS:
        if name == "non_whitelist":
            m = m.select(*done, F.translate("cur", "\n\r", "  ").alias("cur"))
            # The text after the last step is not read; a match is one character.
            count = F.length("cur") - F.length(F.regexp_replace("cur", TX.WHITELIST_RUN, ""))
            m = m.select(*done, count.alias(name), F.lit("").alias("cur"))
        else:
            fast, may = TX.FASTER.get(p, p), TX.MAY_MATCH.get(p, lambda s: F.lit(True))
            got = F.when(may(F.col("cur")), F.size(F.regexp_extract_all("cur", F.lit(fast), 0))).otherwise(0)
            m = m.select(*done, "cur", got.alias(name))
            m = m.select(*done, name, F.when(F.col(name) > 0, F.regexp_replace("cur", F.lit(fast), F.lit("")))
                         .otherwise(F.col("cur")).alias("cur"))
        done.append(name)
    m = m.select(*done)
    parts = F.array(*[F.struct(F.lit(n).alias("step"), F.col(n).alias("k")) for n, _ in _STEPS])
    long = m.select(F.explode(parts).alias("s")).select("s.step", "s.k")
    return long.groupBy("step").agg(F.sum(F.when(F.col("k") > 0, 1).otherwise(0)).cast("long").alias("n_docs"),
                                    F.sum("k").cast("long").alias("n_matches"))


@register("topic_text_clean", f"SELECT doc_id, {topic_clean_sql('text')} AS text_topic FROM documents")
def q_topic_text_clean(spark, sf):
    return docs(spark, sf).select("doc_id", TX.topic_clean("text").alias("text_topic"))


# ------------------------------------------------------------------ B1-B4

@register("raw_text_fields", """
SELECT post_id, comment_id, post_text_raw, comment_text_raw,
       CASE WHEN trim(regexp_replace(comment_text_raw, '\\s', ' ', 'g')) = '' THEN post_text_raw ELSE comment_text_raw END AS text_raw,
       CASE WHEN regexp_full_match(comment_text_raw, '\\s*') THEN post_text_raw ELSE comment_text_raw END AS sentiment_text
FROM (
  SELECT r.conv_id AS post_id, r.turn AS comment_id,
         regexp_replace(coalesce(h.role, '') || ' ' || coalesce(h.text, ''), '^\\s+|\\s+$', '', 'g') AS post_text_raw,
         coalesce(CASE WHEN r.turn > 0 THEN r.text ELSE '' END, '') AS comment_text_raw
  FROM conversations r LEFT JOIN (SELECT conv_id, role, text FROM conversations WHERE turn = 0) h USING (conv_id))""")
def q_raw_text_fields(spark, sf):
    out = TO.raw_text_fields(conv_raw(spark, sf))
    out = out.withColumn("post_text_clean", F.col("post_text_raw")).withColumn("comment_text_clean", F.col("comment_text_raw"))
    out = TO.sentiment_text(out)
    return out.select("post_id", "comment_id", "post_text_raw", "comment_text_raw", "text_raw", "sentiment_text")


# ------------------------------------------------------------------ C2 / C4 / C5 / C10 / F41

@register("tokens_stopworded", f"""
WITH {TOKS} SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM toks""")
def q_tokens_stopworded(spark, sf):
    t = doc_tokens(spark, sf)
    return t.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


# Irregular-form lemma pairs used by the lemma query.
LEMMA_PAIRS = [
    ("children", "child"), ("men", "man"), ("women", "woman"), ("feet", "foot"), ("teeth", "tooth"),
    ("mice", "mouse"), ("people", "person"), ("better", "good"), ("best", "good"), ("worse", "bad"),
    ("worst", "bad"), ("ran", "run"), ("saw", "see"), ("took", "take"), ("made", "make"),
    ("said", "say"), ("went", "go"), ("came", "come"), ("got", "get"), ("gave", "give"),
    ("thought", "think"), ("told", "tell"), ("felt", "feel"), ("found", "find"), ("knew", "know"),
    ("left", "leave"), ("became", "become"), ("began", "begin"), ("brought", "bring"), ("bought", "buy"),
]


def _lemma_sql():
    words = (f"list_transform(list_filter(list_transform(regexp_extract_all({clean_sql('text')}, '[A-Za-z]+'), "
             f"lambda x: lower(x)), lambda x: NOT list_contains({sql_list(NLTK_ENGLISH)}, x)), "
             f"lambda x: coalesce(map_extract(MAP {{{', '.join(f'{chr(39)}{a}{chr(39)}: {chr(39)}{b}{chr(39)}' for a, b in LEMMA_PAIRS)}}}, x)[1], x))")
    return f"SELECT doc_id, array_to_string({words}, ' ') AS text_lem FROM documents"


@register("lemma_text", _lemma_sql())
def q_lemma_text(spark, sf):
    d = docs(spark, sf).select("doc_id", TX.clean_text("text").alias("text_clean"))
    lem = spark.createDataFrame(LEMMA_PAIRS, "term string, lemma string")
    return TO.lemma_text(d, "text_clean", lemmas=lem).select("doc_id", "text_lem")


@register("word_counts_top", """
SELECT word, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS word FROM documents)
WHERE length(word) >= 3 GROUP BY word ORDER BY count DESC, word LIMIT 15""")
def q_word_counts_top(spark, sf):
    return TO.top_words(docs(spark, sf), "text", 15)


@register("term_freq_by_topic", f"""
WITH {TOKS}
SELECT lang, term, n, CAST(rank AS INTEGER) AS rank FROM (
  SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM (
    SELECT lang, term, count(*) AS n FROM (SELECT lang, unnest(t) AS term FROM toks) GROUP BY 1, 2))
WHERE rank <= 100""")
def q_term_freq_by_topic(spark, sf):
    return TO.term_freq_by_group(doc_tokens(spark, sf), "lang", "tokens", 100)


# ------------------------------------------------------------------ C8

_VOCAB = """dfq AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM toks) GROUP BY term),
vocab AS (SELECT term, df FROM dfq, (SELECT count(*) AS n FROM toks) WHERE df >= 5 AND df <= floor(n * 0.5)
          ORDER BY df DESC, term LIMIT 100000)"""


@register("vocab_df_bounds", f"WITH {TOKS}, {_VOCAB} SELECT term, df FROM vocab")
def q_vocab_df_bounds(spark, sf):
    return VO.vocabulary(doc_tokens(spark, sf))


@register("bag_of_words", f"""
WITH {TOKS}, {_VOCAB}
SELECT doc_id, term, count(*) AS count FROM (SELECT doc_id, unnest(t) AS term FROM toks)
WHERE term IN (SELECT term FROM vocab) GROUP BY 1, 2""")
def q_bag_of_words(spark, sf):
    t = doc_tokens(spark, sf, materialized=True)
    return VO.bag_of_words(t, VO.vocabulary(t), "doc_id")


# ------------------------------------------------------------------ C6 / C7

_PHRASES = """ckeys AS (
  SELECT unnest(t) AS key FROM toks
  UNION ALL
  SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS key FROM toks WHERE len(t) >= 2),
cvocab AS (SELECT key, count(*) AS cnt FROM ckeys GROUP BY key),
multi AS (SELECT key AS phrase, cnt AS n_ab, string_split(key, '_')[1] AS first, string_split(key, '_')[-1] AS last
          FROM cvocab WHERE len(string_split(key, '_')) >= 2),
ph AS (SELECT phrase, first, last, n_ab AS count, (n_ab - 5) * 1.0 / (a.cnt * b.cnt) * v AS score
       FROM multi JOIN cvocab a ON a.key = first JOIN cvocab b ON b.key = last, (SELECT count(*) AS v FROM cvocab)
       WHERE (n_ab - 5) * 1.0 / (a.cnt * b.cnt) * v > 10)"""


@register("phrase_scores", f"WITH {TOKS}, {_PHRASES} SELECT phrase, first, last, count, round(score, 6) AS score FROM ph")
def q_phrase_scores(spark, sf):
    return finish(PH.learn_phrases(doc_tokens(spark, sf), "tokens", 5, 10.0))


@register("phrase_merge", f"""
WITH {TOKS}, {_PHRASES},
pos AS (SELECT doc_id, p, t[p + 1] AS tok, t[p + 2] AS nxt FROM (SELECT doc_id, t, unnest(range(len(t))) AS p FROM toks)),
q AS (SELECT *, coalesce(nxt IS NOT NULL AND (tok || '_' || nxt) IN (SELECT phrase FROM ph), false) AS q FROM pos),
pk AS (SELECT *, q AND (p - coalesce(max(CASE WHEN NOT q THEN p END) OVER (PARTITION BY doc_id ORDER BY p
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) - 1) % 2 = 0 AS picked FROM q),
em AS (SELECT *, coalesce(lag(picked) OVER (PARTITION BY doc_id ORDER BY p), false) AS prev_picked FROM pk)
SELECT d.doc_id, coalesce(m.merged, '') AS tokens FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(CASE WHEN picked THEN tok || '_' || nxt ELSE tok END, ' ' ORDER BY p) AS merged
  FROM em WHERE NOT prev_picked GROUP BY doc_id) m USING (doc_id)""")
def q_phrase_merge(spark, sf):
    t = doc_tokens(spark, sf, materialized=True)
    p1 = PH.learn_phrases(t, "tokens", 5, 10.0)
    m = PH.merge_phrases(t, p1, "doc_id", "tokens", "merged")
    return m.select("doc_id", F.array_join("merged", " ").alias("tokens"))


def _phrases_sql(name: str, src: str, min_count: int = 5, threshold: float = 10.0) -> str:
    """CTEs learning phrase table ``name`` (column phrase) from token table ``src`` (doc_id, t)."""
    return f"""{name}_keys AS (
  SELECT unnest(t) AS key FROM {src}
  UNION ALL
  SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || '_' || t[i + 1])) AS key FROM {src} WHERE len(t) >= 2),
{name}_vocab AS (SELECT key, count(*) AS cnt FROM {name}_keys GROUP BY key),
{name}_multi AS (SELECT key AS phrase, cnt AS n_ab, string_split(key, '_')[1] AS first,
                        string_split(key, '_')[-1] AS last FROM {name}_vocab WHERE len(string_split(key, '_')) >= 2),
{name} AS (SELECT phrase FROM {name}_multi JOIN {name}_vocab a ON a.key = first JOIN {name}_vocab b ON b.key = last,
                (SELECT count(*) AS v FROM {name}_vocab)
           WHERE (n_ab - {min_count}) * 1.0 / (a.cnt * b.cnt) * v > {threshold})"""


def _merge_sql(name: str, src: str, ph: str) -> str:
    """CTEs merging token table ``src`` (doc_id, t) with phrase table ``ph`` into ``name`` (doc_id, t)."""
    return f"""{name}_pos AS (SELECT doc_id, p, t[p + 1] AS tok, t[p + 2] AS nxt
                   FROM (SELECT doc_id, t, unnest(range(len(t))) AS p FROM {src})),
{name}_q AS (SELECT *, coalesce(nxt IS NOT NULL AND (tok || '_' || nxt) IN (SELECT phrase FROM {ph}), false) AS q
             FROM {name}_pos),
{name}_pk AS (SELECT *, q AND (p - coalesce(max(CASE WHEN NOT q THEN p END) OVER (PARTITION BY doc_id ORDER BY p
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) - 1) % 2 = 0 AS picked FROM {name}_q),
{name}_em AS (SELECT *, coalesce(lag(picked) OVER (PARTITION BY doc_id ORDER BY p), false) AS prev_picked
              FROM {name}_pk),
{name} AS (SELECT s.doc_id, coalesce(m.t, []::VARCHAR[]) AS t FROM {src} s LEFT JOIN (
             SELECT doc_id, list(CASE WHEN picked THEN tok || '_' || nxt ELSE tok END ORDER BY p) AS t
             FROM {name}_em WHERE NOT prev_picked GROUP BY doc_id) m USING (doc_id))"""


@register("phrase_merge_two_pass", f"""
WITH {TOKS},
{_phrases_sql("p1", "toks")},
{_merge_sql("m1", "toks", "p1")},
{_phrases_sql("p2", "m1")},
{_merge_sql("m2", "toks", "p2")},
{_merge_sql("m3", "m2", "p1")}
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens FROM m3""")
def q_phrase_merge_two_pass(spark, sf):
    """C6 + C7 in the reference order: the second model (learned on pass-1 output)
    is applied to the raw tokens first, then the first model."""
    res, _, _ = PH.learn_and_merge(doc_tokens(spark, sf), "doc_id", "tokens", 5, 10.0)
    return res.select("doc_id", F.size("phrased").alias("n_tokens"), F.array_join("phrased", " ").alias("tokens"))


# ------------------------------------------------------------------ D1-D3

# Query lexicon = default lexicon + function words that occur in the test prose.
QUERY_LEXICON = DEFAULT_LEXICON + [("the", 0.4), ("with", 0.6), ("that", -0.5), ("this", -0.3),
                                   ("for", 0.3), ("by", -0.2)]


def _lexicon(spark):
    return spark.createDataFrame(QUERY_LEXICON, "term string, valence double")


_EDGE = SE._EDGE_PUNCT.replace("'", "''")


def _l0_sql():
    lex_values = ", ".join(f"('{t}', {v})" for t, v in QUERY_LEXICON)
    words = (f"list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''), "
             f"lambda w: CASE WHEN length(regexp_replace(w, '{_EDGE}', '', 'g')) <= 2 THEN w "
             f"ELSE regexp_replace(w, '{_EDGE}', '', 'g') END)")
    return f"""
WITH lex(term, valence) AS (VALUES {lex_values}),
w AS (SELECT doc_id, text, unnest(CASE WHEN len({words}) = 0 THEN [NULL] ELSE {words} END) AS word FROM documents),
s AS (SELECT w.doc_id, any_value(w.text) AS text, coalesce(sum(l.valence), 0.0) AS s,
             coalesce(sum(CASE WHEN l.valence > 0 THEN l.valence + 1 ELSE 0 END), 0.0) AS pos,
             coalesce(sum(CASE WHEN l.valence < 0 THEN l.valence - 1 ELSE 0 END), 0.0) AS neg,
             count(w.word) FILTER (WHERE coalesce(l.valence, 0.0) = 0) AS neu
      FROM w LEFT JOIN lex l ON l.term = lower(w.word) GROUP BY w.doc_id),
r AS (SELECT doc_id, trim(coalesce(text, '')) = '' AS blank, s, pos, neg, neu, pos + abs(neg) + neu AS tot,
             greatest(least(s / sqrt(s * s + 15), 1.0), -1.0) AS c FROM s)
SELECT doc_id,
       CASE WHEN blank THEN 0.0 ELSE round(c, 4) END AS vader_compound,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(pos / tot), 3) ELSE 0.0 END AS vader_pos,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(neu / tot), 3) WHEN blank THEN 1.0 ELSE 0.0 END AS vader_neu,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(neg / tot), 3) ELSE 0.0 END AS vader_neg,
       CASE WHEN (CASE WHEN blank THEN 0.0 ELSE round(c, 4) END) >= 0.05 THEN 'positive'
            WHEN (CASE WHEN blank THEN 0.0 ELSE round(c, 4) END) <= -0.05 THEN 'negative' ELSE 'neutral' END AS vader_label
FROM r"""


@register("lexicon_sentiment_l0", _l0_sql())
def q_lexicon_sentiment_l0(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return SE.lexicon_scores(d, "text", _lexicon(spark), "doc_id", level=0)


@register("lexicon_label", f"""
WITH sc AS ({_l0_sql()})
SELECT d.lang, sc.vader_label AS label, count(*) AS n FROM sc JOIN documents d USING (doc_id) GROUP BY 1, 2""")
def q_lexicon_label(spark, sf):
    d = docs(spark, sf).select("doc_id", "text", "lang")
    s = SE.lexicon_scores(d, "text", _lexicon(spark), "doc_id", level=0).join(d.select("doc_id", "lang"), "doc_id")
    return s.groupBy("lang", F.col("vader_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _l1_sql():
    from ..functions import lexicon as LX
    lex_values = ", ".join(f"('{t}', {v})" for t, v in QUERY_LEXICON)
    up = sql_list(LX.BOOSTERS_UP)[1:-1]
    down = sql_list(LX.BOOSTERS_DOWN)[1:-1]
    negs = sql_list(LX.NEGATIONS)[1:-1]
    words = (f"list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''), "
             f"lambda w: CASE WHEN length(regexp_replace(w, '{_EDGE}', '', 'g')) <= 2 THEN w "
             f"ELSE regexp_replace(w, '{_EDGE}', '', 'g') END)")

    def neg(c):
        return f"coalesce({c} IN ({negs}) OR contains({c}, 'n''t'), false)"

    def sc(k, c):
        f = {0: "1.0", 1: "0.95", 2: "0.9"}[k]
        return (f"(CASE WHEN v < 0 THEN -1 ELSE 1 END) * (CASE WHEN {c} IN ({up}) THEN {LX.BOOST_INCR} "
                f"WHEN {c} IN ({down}) THEN {LX.BOOST_DECR} ELSE 0.0 END) * {f}")

    mult = {
        0: f"CASE WHEN {neg('lp1')} THEN {LX.NEGATION_SCALAR} ELSE 1.0 END",
        1: (f"CASE WHEN coalesce(lp2 = 'never' AND lp1 IN ('so', 'this'), false) THEN 1.25 "
            f"WHEN coalesce(lp2 = 'without' AND lp1 = 'doubt', false) THEN 1.0 "
            f"WHEN {neg('lp2')} THEN {LX.NEGATION_SCALAR} ELSE 1.0 END"),
        2: (f"CASE WHEN coalesce((lp3 = 'never' AND lp2 IN ('so', 'this')) OR lp1 IN ('so', 'this'), false) THEN 1.25 "
            f"WHEN coalesce(lp3 = 'without' AND (lp2 = 'doubt' OR lp1 = 'doubt'), false) THEN 1.0 "
            f"WHEN {neg('lp3')} THEN {LX.NEGATION_SCALAR} ELSE 1.0 END"),
    }
    steps = []
    prev = "b"
    for k in range(3):
        cur = f"k{k}"
        steps.append(f"""{cur} AS (SELECT * REPLACE (CASE WHEN i > {k} AND NOT in_lp{k + 1}
            THEN (v + {sc(k, f'lp{k + 1}')}) * ({mult[k]}) ELSE v END AS v) FROM {prev})""")
        prev = cur
    return f"""
WITH lex(term, valence) AS (VALUES {lex_values}),
d AS (SELECT doc_id, text, trim(coalesce(text, '')) = '' AS blank, {words} AS w FROM documents),
p AS (SELECT doc_id, blank, i, lower(w[i + 1]) AS lw,
             CASE WHEN i >= 1 THEN lower(w[i]) END AS lp1, CASE WHEN i >= 2 THEN lower(w[i - 1]) END AS lp2,
             CASE WHEN i >= 3 THEN lower(w[i - 2]) END AS lp3, lower(w[i + 2]) AS ln1
      FROM (SELECT doc_id, blank, w, unnest(range(len(w))) AS i FROM d)),
b AS (SELECT p.*, l0.valence IS NOT NULL AS inw, coalesce(l0.valence, 0.0) AS v,
             l1.term IS NOT NULL AS in_lp1, l2.term IS NOT NULL AS in_lp2, l3.term IS NOT NULL AS in_lp3
      FROM p LEFT JOIN lex l0 ON l0.term = p.lw LEFT JOIN lex l1 ON l1.term = p.lp1
             LEFT JOIN lex l2 ON l2.term = p.lp2 LEFT JOIN lex l3 ON l3.term = p.lp3),
{", ".join(steps)},
f AS (SELECT doc_id, blank, CASE WHEN lw IN ({up}, {down}) OR coalesce(lw = 'kind' AND ln1 = 'of', false) THEN 0.0
                                 WHEN inw THEN v ELSE 0.0 END AS v FROM {prev}),
g AS (SELECT d.doc_id, d.blank, coalesce(sum(f.v), 0.0) AS s,
             coalesce(sum(CASE WHEN f.v > 0 THEN f.v + 1 ELSE 0 END), 0.0) AS pos,
             coalesce(sum(CASE WHEN f.v < 0 THEN f.v - 1 ELSE 0 END), 0.0) AS neg,
             count(*) FILTER (WHERE f.v = 0) AS neu
      FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id, d.blank),
r AS (SELECT *, pos + abs(neg) + neu AS tot, greatest(least(s / sqrt(s * s + 15), 1.0), -1.0) AS c FROM g)
SELECT doc_id,
       CASE WHEN blank THEN 0.0 ELSE round(c, 4) END AS vader_compound,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(pos / tot), 3) ELSE 0.0 END AS vader_pos,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(neu / tot), 3) WHEN blank THEN 1.0 ELSE 0.0 END AS vader_neu,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(neg / tot), 3) ELSE 0.0 END AS vader_neg,
       CASE WHEN (CASE WHEN blank THEN 0.0 ELSE round(c, 4) END) >= 0.05 THEN 'positive'
            WHEN (CASE WHEN blank THEN 0.0 ELSE round(c, 4) END) <= -0.05 THEN 'negative' ELSE 'neutral' END AS vader_label
FROM r"""


@register("lexicon_sentiment_l1", _l1_sql())
def q_lexicon_sentiment_l1(spark, sf):
    """D1 level 1: lexicon + boosters/dampeners and negation over three predecessors."""
    d = docs(spark, sf).select("doc_id", "text")
    return SE.lexicon_scores(d, "text", _lexicon(spark), "doc_id", level=1)


def _l2_sql():
    """All rules as a chain of steps over each lexicon word and its neighbours."""
    from ..functions import lexicon as LX
    lex_values = ", ".join(f"('{t}', {v})" for t, v in QUERY_LEXICON)
    up, down, negs = (sql_list(x)[1:-1] for x in (LX.BOOSTERS_UP, LX.BOOSTERS_DOWN, LX.NEGATIONS))
    words = (f"list_transform(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''), "
             f"lambda w: CASE WHEN length(regexp_replace(w, '{_EDGE}', '', 'g')) <= 2 THEN w "
             f"ELSE regexp_replace(w, '{_EDGE}', '', 'g') END)")
    boosts = [(b, LX.BOOST_INCR) for b in LX.BOOSTERS_UP if " " in b] + [(b, LX.BOOST_DECR) for b in LX.BOOSTERS_DOWN if " " in b]

    def look(pairs, key, other):
        return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN CAST({v} AS DOUBLE)" for k, v in pairs) + f" ELSE {other} END"

    def idiom(*cols):
        return look(LX.IDIOMS, " || ' ' || ".join(cols), "NULL")

    def neg(c):
        return f"coalesce({c} IN ({negs}) OR contains({c}, 'n''t'), false)"

    mult = [f"CASE WHEN {neg('lp1')} THEN {LX.NEGATION_SCALAR} ELSE 1.0 END",
            f"CASE WHEN lp2 = 'never' AND lp1 IN ('so', 'this') THEN 1.25 WHEN lp2 = 'without' AND lp1 = 'doubt' THEN 1.0 "
            f"WHEN {neg('lp2')} THEN {LX.NEGATION_SCALAR} ELSE 1.0 END",
            f"CASE WHEN (lp3 = 'never' AND lp2 IN ('so', 'this')) OR lp1 IN ('so', 'this') THEN 1.25 "
            f"WHEN lp3 = 'without' AND (lp2 = 'doubt' OR lp1 = 'doubt') THEN 1.0 "
            f"WHEN {neg('lp3')} THEN {LX.NEGATION_SCALAR} ELSE 1.0 END"]
    steps, prev = [], "n2"
    for k in range(3):
        w = f"lp{k + 1}"
        signed = (f"(CASE WHEN v < 0 THEN -1 ELSE 1 END) * CASE WHEN {w} IN ({up}) THEN {LX.BOOST_INCR} "
                  f"WHEN {w} IN ({down}) THEN {LX.BOOST_DECR} ELSE 0.0 END")
        steps.append(f"""s{k} AS (SELECT *, i > {k} AND NOT in_{w} AS ok{k}, {signed} AS sc{k} FROM {prev}),
t{k} AS (SELECT * REPLACE (CASE WHEN ok{k} THEN (v + {(1.0, 0.95, 0.9)[k]} * (sc{k} + CASE WHEN sc{k} <> 0 AND up{k + 1} AND capdiff
  THEN CASE WHEN v > 0 THEN {LX.CAPS_INCR} ELSE -{LX.CAPS_INCR} END ELSE 0 END)) * ({mult[k]}) ELSE v END AS v) FROM s{k})""")
        prev = f"t{k}"
    before = ", ".join(idiom(*c) for c in (("lp1", "lw"), ("lp2", "lp1", "lw"), ("lp2", "lp1"), ("lp3", "lp2", "lp1"), ("lp3", "lp2")))
    added = " + ".join(look(boosts, " || ' ' || ".join(c), "0") for c in (("lp3", "lp2", "lp1"), ("lp3", "lp2"), ("lp2", "lp1")))
    return f"""
WITH lex(term, valence) AS (VALUES {lex_values}),
d0 AS (SELECT doc_id, coalesce(text, '') AS text, {words} AS w FROM documents),
d AS (SELECT doc_id, trim(text) = '' AS blank, w, len(w) AS n, [x = upper(x) AND x <> lower(x) FOR x IN w] AS caps,
             coalesce(list_position([lower(x) FOR x IN w], 'but'), 0) - 1 AS bi,
             least(length(text) - length(replace(text, '!', '')), {LX.EXCLAIM_MAX}) * {LX.EXCLAIM_STEP}::DOUBLE AS ex,
             length(text) - length(replace(text, '?', '')) AS nq FROM d0),
d2 AS (SELECT *, len(list_filter(caps, lambda x: x)) BETWEEN 1 AND n - 1 AS capdiff,
              ex + CASE WHEN nq > 3 THEN {LX.QUESTION_MAX}::DOUBLE WHEN nq > 1 THEN nq * {LX.QUESTION_STEP}::DOUBLE ELSE 0 END AS punct FROM d),
p AS (SELECT doc_id, n, bi, capdiff, i, lower(w[i + 1]) AS lw, caps[i + 1] AS up0,
             CASE WHEN i >= 1 THEN lower(w[i]) END AS lp1, CASE WHEN i >= 2 THEN lower(w[i - 1]) END AS lp2,
             CASE WHEN i >= 3 THEN lower(w[i - 2]) END AS lp3, lower(w[i + 2]) AS ln1, lower(w[i + 3]) AS ln2,
             i >= 1 AND caps[i] AS up1, i >= 2 AND caps[i - 1] AS up2, i >= 3 AND caps[i - 2] AS up3
      FROM (SELECT *, unnest(range(n)) AS i FROM d2)),
b AS (SELECT p.*, CAST(l0.valence AS DOUBLE) AS v, CAST(l0.valence AS DOUBLE) AS v0, l1.term IS NOT NULL AS in_lp1,
             l2.term IS NOT NULL AS in_lp2, l3.term IS NOT NULL AS in_lp3, ln.term IS NOT NULL AS in_ln1
      FROM p JOIN lex l0 ON l0.term = p.lw LEFT JOIN lex l1 ON l1.term = p.lp1 LEFT JOIN lex l2 ON l2.term = p.lp2
             LEFT JOIN lex l3 ON l3.term = p.lp3 LEFT JOIN lex ln ON ln.term = p.ln1),
n0 AS (SELECT * REPLACE (CASE WHEN lw = 'no' AND i <> n - 1 AND in_ln1 THEN 0 ELSE v END AS v) FROM b),
n1 AS (SELECT * REPLACE (CASE WHEN coalesce(lp1 = 'no', false) OR coalesce(lp2 = 'no', false)
                              OR coalesce(lp3 = 'no' AND lp1 IN ('or', 'nor'), false) THEN v0 * {LX.NEGATION_SCALAR} ELSE v END AS v) FROM n0),
n2 AS (SELECT * REPLACE (CASE WHEN up0 AND capdiff THEN CASE WHEN v > 0 THEN v + {LX.CAPS_INCR} ELSE v - {LX.CAPS_INCR} END ELSE v END AS v) FROM n1),
{", ".join(steps)},
i0 AS (SELECT * REPLACE (CASE WHEN ok2 THEN coalesce({idiom("lw", "ln1", "ln2")}, {idiom("lw", "ln1")}, {before}, v) + {added}
                              ELSE v END AS v) FROM t2),
i1 AS (SELECT * REPLACE (CASE WHEN lp1 = 'least' AND NOT in_lp1 AND (i = 1 OR lp2 NOT IN ('at', 'very'))
                              THEN v * {LX.NEGATION_SCALAR} ELSE v END AS v) FROM i0),
i2 AS (SELECT * REPLACE (CASE WHEN lw IN ({up}, {down}) OR coalesce(lw = 'kind' AND ln1 = 'of', false) THEN 0 ELSE v END AS v) FROM i1),
f AS (SELECT doc_id, v * CASE WHEN bi < 0 OR i = bi THEN 1.0 WHEN i < bi THEN 0.5 ELSE 1.5 END AS v FROM i2),
g AS (SELECT d2.doc_id, any_value(blank) AS blank, any_value(punct) AS p, coalesce(sum(f.v), 0) AS s0,
             coalesce(sum(CASE WHEN f.v > 0 THEN f.v + 1 END), 0) AS pos, coalesce(sum(CASE WHEN f.v < 0 THEN f.v - 1 END), 0) AS neg,
             any_value(n) - count(*) FILTER (f.v <> 0) AS neu
      FROM d2 LEFT JOIN f ON f.doc_id = d2.doc_id GROUP BY d2.doc_id),
h AS (SELECT doc_id, blank, neu, s0 + sign(s0) * p AS s, pos + CASE WHEN pos > abs(neg) THEN p ELSE 0 END AS pos,
             neg - CASE WHEN pos < abs(neg) THEN p ELSE 0 END AS neg FROM g),
r AS (SELECT *, pos + abs(neg) + neu AS tot, CASE WHEN blank THEN 0.0 ELSE round(greatest(least(s / sqrt(s * s + 15), 1.0), -1.0), 4) END AS c FROM h)
SELECT doc_id, c AS vader_compound,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(pos / tot), 3) ELSE 0.0 END AS vader_pos,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(neu / tot), 3) WHEN blank THEN 1.0 ELSE 0.0 END AS vader_neu,
       CASE WHEN tot > 0 AND NOT blank THEN round(abs(neg / tot), 3) ELSE 0.0 END AS vader_neg,
       CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS vader_label
FROM r"""


@register("lexicon_sentiment", _l2_sql())
def q_lexicon_sentiment(spark, sf):
    """D1 with every rule (level 2); also checked against a brute-force scorer in tests."""
    d = docs(spark, sf).select("doc_id", "text")
    return SE.lexicon_scores(d, "text", _lexicon(spark), "doc_id", level=2)


# Sentences in which every rule of the full model applies, put before the texts of the corpus.
_RULED = [
    "The food is GOOD but the service was really bad!", "kind of good", "not very good, never so good", "the least helpful one",
    "at least good", "It is the bomb good thing now", "no good or no hope???", "I was just enough of this great day!!",
    "without doubt great", "no", "so TERRIBLE and EXTREMELY nice", "that is sort of a bad sad thing", "yeah right good", "very good!!!!!!"]
_RULED_SQL = " ".join(f"WHEN {i} THEN '{t}' " for i, t in enumerate(_RULED))


@register("lexicon_rules", "WITH documents AS (SELECT doc_id, CASE doc_id % 14 " + _RULED_SQL + " END || ' ' || coalesce(text, '') AS text "
          "FROM documents) SELECT * FROM (" + _l2_sql() + ")")
def q_lexicon_rules(spark, sf):
    """D1, every rule, over the corpus with a ruled sentence before each text."""
    lead = F.element_at(F.array(*[F.lit(t) for t in _RULED]), (F.col("doc_id") % len(_RULED) + 1).cast("int"))
    d = docs(spark, sf).select("doc_id", F.concat(lead, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    return SE.lexicon_scores(d, "text", _lexicon(spark), "doc_id", level=2)
