"""Toxicity by Levenshtein automata over a lexicon trie (operator 3).

A lexicon of weighted terms and stems is learned from labelled documents (document
counts of words and word beginnings, smoothed log odds) on top of a short stated
seed list. Its trie is walked together with the Levenshtein automaton of each
distinct word: a state is the automaton's row of edit distances, a branch ends when
no entry of the row is within the allowed edits, and a stem accepts whatever
follows it, also after a slip inside the stem. So misspelled terms are found without listing their spellings.

A hit counts by its context window: inside quotation marks or after a reporting
word it is a mention and counts little; with a word of address beside it, it counts
fully. A logistic regression over a document's hit sums gives the score.

Learning reads every labelled row that is not held out: Spark counts the entries of both
labels and only those that stand out come to the driver. Scoring is row-local over all
documents, with one small broadcast model.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices_by_bytes, stored, written

# A learned entry: toxic documents it must be in, and its least log odds.
MIN_DOCS, MIN_ODDS = 4, 3.0
STEM_CHARS = (4, 5, 6, 7)
MAX_EDITS = 1
# Letters from which a term, or a stem, may be misspelled.
FUZZY_CHARS, FUZZY_STEM = 4, 5
WINDOW = 5
MENTION = 0.25
THRESHOLD = 0.3
CACHE_WORDS = 500_000
# Entries whose counts a task holds at a time.
COUNTED = 300_000
# Bytes of labelled ids that may be broadcast (about 32 a row); above, the planner joins by shuffle.
IDS_BYTES = 16 << 20

# Seed insults, words that report speech, words of address.
SEEDS = ("asshole bastard bitch clown cretin disgusting dumbass filth fool idiot imbecile jerk loser moron "
         "pathetic pig scumbag scum stupid trash vermin worthless "
         "abschaum arschloch dummkopf idiotin schwein "
         "cabrón estúpido estúpida idiota imbécil "
         "connard crétin débile imbécile ordure salaud").split()
SEED_WEIGHT = 4.0
REPORTS = frozenset("said says called calling term word quote quoted quoting wrote written phrase insult "
                    "nannte wort sagte dijo palabra llamó dit mot appelé".split())
ADDRESS = frozenset("you your youre are is du dein bist ihr tu eres usted tú vous tes es".split())
QUOTES = "\"“”„«»‹›"

WORD = re.compile(r"[^\W\d_]+")
SPLIT = re.compile(r"([^\W\d_]+)")


def words_and_pairs(low: str) -> tuple[list[str], list[str], dict[int, str]]:
    """The text cut into gaps and words in turn, the words, and by place of the first the pairs of
    words about one digit or symbol, as in ``id1ot``: all that one edit can have cut in two."""
    parts = SPLIT.split(low)
    words = parts[1::2]
    pairs = {i: words[i] + gap + words[i + 1] for i, gap in enumerate(parts[2:-1:2])
             if gap != " " and len(gap) == 1 and not gap.isspace()}
    return parts, words, pairs


def forms(low: str) -> set[str]:
    """The words of a text and the pairs about one inner digit or symbol."""
    _, words, pairs = words_and_pairs(low)
    return {*words, *pairs.values()}


class Trie:
    """Lexicon entries ``term -> (weight, is stem)`` as nested dicts; key "" holds the entry."""

    def __init__(self, entries: dict[str, tuple[float, bool]], max_edits: int = MAX_EDITS):
        self.root: dict = {}
        self.max_edits = max_edits
        self.longest = max(map(len, entries), default=0)
        # By length of term (or of stem): first and second halves, for near().
        self.terms: dict[int, tuple[set[str], set[str]]] = {}
        self.stems: dict[int, tuple[set[str], set[str]]] = {}
        for term, (weight, stem) in entries.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[""] = (weight, stem, term)
            if len(term) >= (FUZZY_STEM if stem else FUZZY_CHARS):
                heads, tails = (self.stems if stem else self.terms).setdefault(len(term), (set(), set()))
                heads.add(term[:len(term) // 2])
                tails.add(term[len(term) // 2:])

    def exact(self, word: str) -> tuple[float, int] | None:
        node, best = self.root, None
        for c in word:
            node = node.get(c)
            if node is None:
                return best
            if "" in node and node[""][1]:
                best = max(best or (0.0, 0), (node[""][0], 0))
        return max(best or (0.0, 0), (node[""][0], 0)) if "" in node else best

    def near(self, word: str) -> bool:
        """Whether a term or stem within one edit is possible: an edit leaves one half of it as it
        was, but for a swap of the letters where the halves meet."""
        if self.max_edits != 1:
            return True
        size = len(word)
        for n in (size - 1, size, size + 1):
            if n in self.terms:
                heads, tails = self.terms[n]
                half = n // 2
                if (word[:half] in heads or word[half - n:] in tails
                        or (n == size and word[:half - 1] + word[half] in heads)):
                    return True
        for n, (heads, tails) in self.stems.items():
            half = n // 2
            if n <= size and (word[:half] in heads or word[:half - 1] + word[half] in heads
                              or any(word[half + d:n + d] in tails for d in (-1, 0, 1))):
                return True
        return False

    def fuzzy(self, word: str) -> tuple[float, int] | None:
        """Best ``(weight, edits)`` of terms within ``max_edits`` edits of the word, or of stems that
        near one of its beginnings: the trie and the word's automaton in step. Two neighbouring
        letters swapped are one edit. A word shorter than a stem is none of its family, as a stem
        has at least one more letter."""
        k = self.max_edits
        size = len(word)
        word = word[:self.longest + k + 1]  # what follows is past every term and stem
        n = len(word)
        # States of the automaton: letters of the word read, edits made. Without edits left it only reads on.
        least: dict = {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, edits = stack.pop()
            while node is not None:
                entry = node.get("")
                if entry and len(entry[2]) >= (FUZZY_STEM if entry[1] else FUZZY_CHARS) and \
                        (len(entry[2]) <= size if entry[1] else i == n):
                    least[entry] = min(edits, least.get(entry, k))
                c = word[i] if i < n else ""
                if edits < k:
                    for x, child in node.items():
                        if x:
                            stack.append((child, i, edits + 1))  # a letter left out
                            if c and x != c:
                                stack.append((child, i + 1, edits + 1))  # another letter
                    if c:
                        stack.append((node, i + 1, edits + 1))  # a letter too many
                        if i + 1 < n and word[i + 1] != c and word[i + 1] in node and c in node[word[i + 1]]:
                            stack.append((node[word[i + 1]][c], i + 2, edits + 1))
                node = node.get(c) if c else None
                i += 1
        return max(((weight, edits) for (weight, *_), edits in least.items()), default=None)

    def match(self, word: str) -> tuple[float, int] | None:
        """Of a word or a form with an inner symbol."""
        got = self.exact(word)
        if got is None and len(word) >= FUZZY_CHARS - self.max_edits and self.near(word):
            got = self.fuzzy(word)
        return got


@dataclass
class Model:
    entries: dict[str, tuple[float, bool]]
    common: frozenset = frozenset()  # spellings near a term that clean documents use
    weights: tuple = (0.0,) * 5
    bias: float = 0.0
    version: str = field(default="")


def is_mention(text: str, a: int, b: int, before: list[str]) -> bool:
    """Whether the hit at ``text[a:b]`` stands in quotation marks or after a reporting word."""
    left, right = text[max(0, a - 30):a], text[b:b + 30]
    line_l, line_r = left.rpartition("\n")[2], right.partition("\n")[0]
    if any(q in line_l for q in QUOTES) and any(q in line_r for q in QUOTES):
        return True
    return any(w in REPORTS for w in before)


def features(text: str | None, trie: Trie, common: frozenset, cache: dict) -> tuple[float, ...]:
    """Of a document: log sums of exact and misspelled hits, strongest hit, share of hits among
    the words, hits with a word of address in their window."""
    low = (text or "").lower()
    parts, found, pairs = words_and_pairs(low)
    own = {*found, *pairs.values()}
    for w in own.difference(cache):
        got = trie.match(w)
        cache[w] = None if got is None or (got[1] and w in common) else got
    hits = {w: got for w in own if (got := cache[w]) is not None}
    if len(cache) > CACHE_WORDS:
        cache.clear()
    if not hits:
        return (0.0,) * 5
    exact = fuzzy = top = addressed = 0.0
    ends = [*accumulate(map(len, parts))]
    for i, w in enumerate(found):
        if w not in hits and i in pairs and found[i + 1] not in hits:
            w = pairs[i]
        if w in hits:
            weight, edits = hits[w]
            around = found[max(0, i - WINDOW):i]
            factor = MENTION if is_mention(low, ends[2 * i], ends[2 * i + 1], around) else 1.0
            if any(x in ADDRESS for x in around[-2:]):
                addressed += factor
            weight *= factor
            exact, fuzzy = (exact, fuzzy + weight) if edits else (exact + weight, fuzzy)
            top = max(top, weight if not edits else 0.0)
    return (math.log1p(exact), math.log1p(fuzzy), top, exact / len(found), math.log1p(addressed))


def score_of(x: tuple[float, ...], model: Model) -> float:
    z = model.bias + sum(a * b for a, b in zip(x, model.weights))
    return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(id_col) -> F.Column:
    """Rows never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """``k, text, y`` of all labelled documents that are not held out."""
    key = F.col(f"`{label_id}`").cast("long")
    y = F.col(f"`{label_col}`").cast("int")
    own = stored(labels.select(key.alias("k"), y.alias("y")).where("k is not null and y is not null")
                       .where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y")))
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), F.col(f"`{text_col}`").alias("text"))
    own = F.broadcast(own) if own.count() * 32 <= IDS_BYTES else own
    return written(src.join(own, "k").select("k", "text", "y"), "tox-train")


def group_mark(text: str | None) -> int:
    """Smallest hash of a text's five-word runs: near copies mostly have the same."""
    w = WORD.findall((text or "").lower())
    return min(zlib.crc32(" ".join(w[i:i + 5]).encode()) for i in range(max(1, len(w) - 4)))


def one_a_group(train: DataFrame) -> DataFrame:
    """One row for each mark and label, so that copies don't vouch for a term's spread."""
    marked = train.withColumn("g", F.udf(group_mark, "long")("text"))
    return written(marked.groupBy("g", "y").agg(F.min_by("text", "k").alias("text")), "tox-groups")


def words_of(low: str) -> set[str]:
    return set(WORD.findall(low))


def _counts(rows: DataFrame, keep, parts=words_of) -> DataFrame:
    """``w, toxic, clean``: documents of either label (``y``) that hold each entry ``keep(set of
    words)`` names; summed by Spark."""
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals = Counter(), Counter()

        def flush():
            for y, total in enumerate(totals):
                none = [0] * len(total)
                n = list(total.values())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(total), pa.string()), pa.array(n if y else none, pa.int64()),
                     pa.array(none if y else n, pa.int64())], names=["w", "toxic", "clean"])
                total.clear()

        for batch in batches:
            for part in slices_by_bytes(batch, 0):
                for t, y in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if y in (0, 1):
                        totals[y].update(keep(parts((t or "").lower())))
                    if len(totals[0]) + len(totals[1]) > COUNTED:
                        yield from flush()
        yield from flush()

    return rows.select("text", "y").mapInArrow(work, "w string, toxic long, clean long").groupBy("w").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def with_stems(words: set[str]) -> set[str]:
    """Words, and their beginnings marked with a final ``*``."""
    return words | {w[:k] + "*" for w in words for k in STEM_CHARS if len(w) > k}


def learn_lexicon(train: DataFrame, n_toxic: int, n_clean: int) -> dict[str, tuple[float, bool]]:
    """Terms and stems whose log odds between toxic and clean documents stand out."""
    log_odds = F.log((F.col("toxic") + .5) / (n_toxic + 1)) - F.log((F.col("clean") + .5) / (n_clean + 1))
    # Only entries that stand out come here: they are few, whatever the vocabulary.
    rows = _counts(train, with_stems).where((F.col("toxic") >= MIN_DOCS) & (log_odds >= MIN_ODDS - 1e-6)).collect()
    odds = {r.w: math.log((r.toxic + .5) / (n_toxic + 1)) - math.log((r.clean + .5) / (n_clean + 1)) for r in rows}
    good = {w: o for w, o in odds.items() if o >= MIN_ODDS}
    cand = {r.w: r.toxic for r in rows}
    terms = {w: o for w, o in good.items() if not w.endswith("*")}
    entries = {w: (SEED_WEIGHT, False) for w in SEEDS}
    stems: list[str] = []
    for s in sorted((w[:-1] for w in good if w.endswith("*")), key=lambda s: (len(s), s)):
        whole = max((cand[w] for w in terms if w.startswith(s)), default=0)
        if cand[s + "*"] >= 1.5 * whole and not s.startswith(tuple(stems)):
            stems.append(s)
    # The longest beginning that nearly all of a stem's documents share is the safer one.
    stems = [max((w[:-1] for w in good if w.endswith("*") and w.startswith(s) and cand[w] >= 0.95 * cand[s + "*"]),
                 key=lambda w: (len(w), w)) for s in stems]
    # A stem too short for the automaton keeps its family's terms, whose misspellings are looked up.
    long = tuple(s for s in stems if len(s) >= FUZZY_STEM)
    learned = {w: (o, False) for w, o in terms.items() if not w.startswith(long)}
    learned |= {s: (good[s + "*"], True) for s in stems}
    return entries | learned


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_id: str = "doc_id", label_col: str = "toxic") -> Model:
    """Learn lexicon and regression from all labelled documents that are not held out. Without documents of both labels the seed lexicon scores by a fixed rule."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    train = labelled(docs, labels, id_col, text_col, label_id, label_col)
    n = {r.y: r.n for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model({w: (SEED_WEIGHT, False) for w in SEEDS}, weights=(2.0, 0.5, 0.3, 1.0, 0.3), bias=-3.0)
    single = one_a_group(train)
    n = {r.y: r.n for r in single.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(learn_lexicon(single, n[1], n[0]))
    trie = Trie(model.entries)

    def spelled(words: set[str], cache: dict = {}) -> set[str]:  # noqa: B006 - lives as long as the task
        for w in [w for w in words if w not in cache]:
            got = trie.match(w)
            cache[w] = got is not None and got[1] > 0
        own = {w for w in words if cache[w]}
        if len(cache) > CACHE_WORDS:
            cache.clear()
        return own

    near = _counts(single.where("y = 0"), spelled, forms).where(F.col("clean") >= 2).collect()
    model.common = frozenset(r.w for r in near)
    spark = docs.sparkSession
    x = F.udf(lambda t, cache={}: list(features(t, trie, model.common, cache)), "array<double>")  # noqa: B006
    rows_x = stored(train.select(array_to_vector(x("text")).alias("features"), F.col("y").cast("double").alias("label")))
    got = LogisticRegression(regParam=0.001, maxIter=50).fit(rows_x)
    model.weights, model.bias = tuple(got.coefficients.toArray().tolist()), float(got.intercept)
    model.version = str(spark.sparkContext.applicationId)
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted`` of every row. A null text scores like an empty one (no hits);
    null and repeated ids keep their rows; an empty table gives no rows; other columns
    are ignored."""
    # Plain values: an object of this package is pickled by its class's name, which executors
    # without a copy of the package can't load.
    sent = docs.sparkSession.sparkContext.broadcast((model.entries, model.common, model.weights, model.bias))

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = Model(*sent.value)
        trie = Trie(m.entries)
        cache: dict = {}
        for batch in batches:
            for part in slices_by_bytes(batch, 1):
                s = [score_of(features(t, trie, m.common, cache), m) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())],
                    names=["doc_id", "score", "predicted"])

    src = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    return src.mapInArrow(work, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``; the decision goes with the text.

    A null text scores like an empty one, null and repeated ids keep their rows, all columns
    stay as they are, an empty table gives an empty one."""
    model = fit(docs, labels, id_col, text_col)
    h = F.xxhash64(F.col(f"`{text_col}`"))
    bad = stored(score(docs.withColumn("__h", h), model, "__h", text_col, threshold)
                 .where("predicted = 1").select(F.col("doc_id").alias("__h")).distinct())
    return docs.join(bad, h == bad["__h"], "left_anti")
