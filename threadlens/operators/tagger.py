"""Part of speech and lemma by rules (C2): suffix scores with an exception table, the best tag
sequence of a sentence by Viterbi's algorithm, and suffix rewriting by tag.

Words stay where their row stands: no join, no shuffle. ``lemma_tagged`` works on many rows' words at
once (Arrow batches, numpy); the column expressions say the same for a single sentence.
The tables below are small defaults; every one is an argument.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stopwords import NLTK_ENGLISH
from .words import letter_runs, slices

TAGS = ("noun", "verb", "adjective", "other")


@dataclass(frozen=True)
class Grammar:
    """Log-scale weights: how well a tag fits a word, and how well one tag follows another."""

    prior: dict = field(default_factory=lambda: {"noun": 0.0, "verb": -0.6, "adjective": -0.9, "other": -1.5})
    # Word endings that speak for a tag.
    endings: tuple = (
        ("ing", "verb", 1.4), ("ed", "verb", 1.5), ("ify", "verb", 1.2), ("ize", "verb", 1.3), ("ise", "verb", 0.6),
        ("tion", "noun", 1.6), ("ment", "noun", 1.2), ("ness", "noun", 1.6), ("ity", "noun", 1.3), ("er", "noun", 0.4),
        ("ous", "adjective", 1.8), ("ful", "adjective", 1.7), ("able", "adjective", 1.6), ("ive", "adjective", 1.3),
        ("al", "adjective", 0.9), ("est", "adjective", 1.1), ("ly", "other", 2.0))
    # Words with scores of their own, in the order of the tags.
    words: tuple = (
        ("the", (-9.0, -9.0, -9.0, 0.0)), ("a", (-9.0, -9.0, -9.0, 0.0)), ("an", (-9.0, -9.0, -9.0, 0.0)),
        ("to", (-9.0, -9.0, -9.0, 0.0)), ("of", (-9.0, -9.0, -9.0, 0.0)), ("and", (-9.0, -9.0, -9.0, 0.0)),
        ("in", (-9.0, -9.0, -9.0, 0.0)), ("is", (-9.0, 0.0, -9.0, -9.0)), ("was", (-9.0, 0.0, -9.0, -9.0)),
        ("are", (-9.0, 0.0, -9.0, -9.0)), ("they", (-0.5, -9.0, -9.0, 0.0)), ("he", (-0.5, -9.0, -9.0, 0.0)),
        ("she", (-0.5, -9.0, -9.0, 0.0)), ("not", (-9.0, -9.0, -9.0, 0.0)), ("very", (-9.0, -9.0, -9.0, 0.0)))
    start: tuple = (-0.5, -1.5, -1.2, -0.4)
    # Row: the tag before; column: the tag after.
    follows: tuple = ((-1.1, -0.6, -2.0, -0.8), (-0.9, -1.8, -1.2, -0.7), (-0.3, -2.2, -1.3, -1.6), (-0.5, -0.9, -0.8, -1.6))
    # (tag, ending, replacement, least length): the first that fits is applied.
    rewrite: tuple = (
        ("noun", "ies", "y", 5), ("noun", "sses", "ss", 6), ("noun", "shes", "sh", 6), ("noun", "ches", "ch", 6),
        ("noun", "ss", "ss", 3), ("noun", "us", "us", 3), ("noun", "is", "is", 3), ("noun", "s", "", 4),
        ("verb", "ying", "y", 6), ("verb", "ing", "", 6), ("verb", "ied", "y", 5), ("verb", "eed", "eed", 4),
        ("verb", "ed", "", 5), ("verb", "ies", "y", 5), ("verb", "ss", "ss", 3), ("verb", "s", "", 4),
        ("adjective", "iest", "y", 6), ("adjective", "ier", "y", 6), ("adjective", "est", "", 6))
    # (word, tag, lemma): looked up before the rules.
    irregular: tuple = (
        ("is", "verb", "be"), ("are", "verb", "be"), ("was", "verb", "be"), ("went", "verb", "go"), ("said", "verb", "say"),
        ("thing", "noun", "thing"), ("men", "noun", "man"), ("women", "noun", "woman"), ("children", "noun", "child"),
        ("feet", "noun", "foot"), ("left", "verb", "leave"), ("left", "adjective", "left"), ("best", "adjective", "good"))


def _doubles(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def emissions(word: Column, g: Grammar) -> Column:
    """The word's score for every tag: its own scores, else prior plus what its endings say."""
    def ruled(tag: str) -> Column:
        out = F.lit(float(g.prior[tag]))
        for ending, t, w in g.endings:
            if t == tag:
                out = out + F.when(word.endswith(ending), F.lit(float(w))).otherwise(F.lit(0.0))
        return out

    rules = F.array(*[ruled(t) for t in TAGS])
    if not g.words:
        return rules
    own = F.create_map(*[x for w, s in g.words for x in (F.lit(w), _doubles(s))])
    return F.coalesce(F.element_at(own, word), rules)


STATE = "struct<score:array<double>,back:array<array<int>>>"


def viterbi(scores: Column, g: Grammar) -> Column:
    """Tag numbers (from 0) of the best sequence for an array of score arrays; of equally good
    predecessors or ends the first tag in :data:`TAGS`. An empty sentence has none."""
    n = len(TAGS)
    columns = [_doubles([g.follows[i][j] for i in range(n)]) for j in range(n)]

    def step(acc: Column, own: Column) -> Column:
        def into(j: int) -> Column:
            return F.zip_with(acc["score"], columns[j], lambda s, t: s + t)

        score = F.array(*[F.array_max(into(j)) + F.get(own, F.lit(j)) for j in range(n)])
        best = F.array(*[(F.array_position(into(j), F.array_max(into(j))) - 1).cast("int") for j in range(n)])
        first = F.struct(F.zip_with(_doubles(g.start), own, lambda a, b: a + b).alias("score"),
                         F.array(F.array(*[F.lit(-1)] * n)).alias("back")).cast(STATE)
        return F.when(F.size(acc["back"]) == 0, first).otherwise(F.struct(
            score.alias("score"), F.concat(acc["back"], F.array(best)).alias("back")).cast(STATE))

    empty = F.struct(F.array().cast("array<double>").alias("score"),
                     F.array().cast("array<array<int>>").alias("back")).cast(STATE)

    def path(acc: Column) -> Column:
        last = (F.array_position(acc["score"], F.array_max(acc["score"])) - 1).cast("int")
        # Back from the end; the first word's pointer leads nowhere.
        steps = F.reverse(F.slice(acc["back"], 2, F.greatest(F.size(acc["back"]) - 1, F.lit(0))))
        return F.when(F.size(acc["back"]) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(
            steps, F.array(last).cast("array<int>"), lambda p, b: F.concat(F.array(F.get(b, F.get(p, F.lit(0)))), p).cast("array<int>")))

    return F.aggregate(scores, empty, step, path)


def lemma_of(word: Column, tag: Column, g: Grammar) -> Column:
    """The word's lemma as the tag has it."""
    out = None
    for t, ending, new, least in g.rewrite:
        fits = (tag == TAGS.index(t)) & word.endswith(ending) & (F.length(word) >= least)
        value = F.concat(F.substr(word, F.lit(1), F.length(word) - len(ending)), F.lit(new))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    ruled = word if out is None else out.otherwise(word)
    if not g.irregular:
        return ruled
    known = F.create_map(*[F.lit(x) for w, t, lemma in g.irregular for x in (f"{w}/{TAGS.index(t)}", lemma)])
    return F.coalesce(F.element_at(known, F.concat(word, F.lit("/"), tag.cast("string"))), ruled)


def sentences(text: Column) -> Column:
    """Lower-case alphabetic words of each sentence (ended by ``. ! ?``); sentences without words go."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[.!?]+")
    return F.filter(F.transform(parts, lambda s: F.regexp_extract_all(s, F.lit("[a-z]+"), F.lit(0))), lambda w: F.size(w) > 0)


def tag_words(words, first, sizes, g: Grammar):
    """Tag numbers of a string array's words; sentence i has ``sizes[i]`` (at least one) words from
    ``first[i]`` on. All sentences take :func:`viterbi`'s steps at once, in numpy."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = words.dictionary_encode()
    known, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    fit = np.tile([float(g.prior[t]) for t in TAGS], (len(known), 1))
    for ending, t, w in g.endings:
        fit[pc.ends_with(known, ending).to_numpy(zero_copy_only=False).astype(bool), TAGS.index(t)] += float(w)
    if g.words:
        own = pc.index_in(known, value_set=pa.array([w for w, _ in g.words])).to_numpy(zero_copy_only=False)
        own = np.nan_to_num(own.astype(float), nan=-1).astype(int)
        fit[own >= 0] = np.array([s for _, s in g.words], float)[own[own >= 0]]
    fit = fit[code]
    order = np.argsort(-sizes, kind="stable")
    first, sizes = first[order], sizes[order]
    # The sentences that have a word at place t: the longest come first.
    live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
    follows = np.array(g.follows, float)
    score, back = np.array(g.start, float) + fit[first], np.zeros((len(code), len(TAGS)), np.int8)
    for t in range(1, len(live)):
        at = first[:live[t]] + t
        into = score[:live[t], :, None] + follows
        back[at] = into.argmax(axis=1)
        score[:live[t]] = into.max(axis=1) + fit[at]
    tags = np.zeros(len(code), np.int64)
    tags[first + sizes - 1] = score.argmax(axis=1)
    for t in range(len(live) - 1, 0, -1):
        at = first[:live[t]] + t
        tags[at - 1] = back[at, tags[at]]
    return tags


def lemmas_of(words, tags, g: Grammar) -> list:
    """:func:`lemma_of` of lists."""
    rules = [[r[1:] for r in g.rewrite if r[0] == t] for t in TAGS]
    known = {(w, TAGS.index(t)): lemma for w, t, lemma in g.irregular}
    out = []
    for w, t in zip(words, tags):
        lemma = known.get((w, t))
        if lemma is None:
            lemma = next((w[:len(w) - len(e)] + new for e, new, least in rules[t] if len(w) >= least and w.endswith(e)), w)
        out.append(lemma)
    return out


def lemma_tagged(df: DataFrame, text_col: str, out: str = "text_lem", stopwords=None, grammar: Grammar | None = None) -> DataFrame:
    """C2 with part of speech: ``df`` with ``out`` (lemmas of the alphabetic words that are no
    stopwords, joined by a space) and ``tagged`` (``array<struct<word, tag, lemma>>`` of all words
    in order). NULL or blank text gives "" and an empty array; rows may repeat."""
    g = grammar or Grammar()
    stop = set(NLTK_ENGLISH if stopwords is None else stopwords)
    names = [c for c in df.columns if c not in (out, "tagged")]
    rows = df.select(*names, F.lower(F.coalesce(text_col, F.lit(""))).alias("_s"))
    cut, runs, tag, rewrite, kinds = slices, letter_runs, tag_words, lemmas_of, TAGS

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for part in cut(batch, len(names)):
                words, row, data, start = runs(part.column(len(names)))
                # A sentence begins with a row or after one of its ends.
                ends = np.cumsum((data == 33) | (data == 46) | (data == 63))[start] if len(start) else start
                new = np.ones(len(start), bool)
                new[1:] = (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])
                first = np.flatnonzero(new)
                tags = tag(words, first, np.diff(np.append(first, len(start))), g) if len(start) else start
                # Every pair of a word and a tag is rewritten once.
                coded = words.dictionary_encode()
                pair, of = np.unique(coded.indices.to_numpy(zero_copy_only=False) * np.int64(len(kinds)) + tags, return_inverse=True)
                own = coded.dictionary.take(pa.array(pair // len(kinds))).to_pylist()
                lemma = pa.array(rewrite(own, (pair % len(kinds)).tolist(), g), pa.string()).take(pa.array(of))
                kept = np.array([w not in stop for w in own], bool)[of]
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.StructArray.from_arrays(
                    [words, pa.array(kinds).take(pa.array(tags)), lemma], names=["word", "tag", "lemma"]))
                cuts = np.concatenate([[0], np.cumsum(kept)])[at]
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), lemma.filter(pa.array(kept))), " ")
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(names))], lists, text],
                                                 names=[*names, "tagged", out])

    schema = df.select(*names, F.lit(None).cast("array<struct<word:string,tag:string,lemma:string>>").alias("tagged"),
                       F.lit(None).cast("string").alias(out)).schema
    return rows.mapInArrow(work, schema)
