"""Personal data by candidate gradient boosting (operator 7), in DataFrame expressions only.

Base rules find e-mail addresses, IP addresses, card and phone numbers; those that
pass their check always stay. High-recall generators propose further, overlapping
spans (addresses written out with "at" and "dot", long groups of digits). Boosted
trees, trained on all examples of the corpus, score them by format and context. Their labels don't
repeat the base rules: examples are the base spans found in the documents, rewritten in
place into forms that the base rules miss (addresses with "at" and "dot" in words or
brackets, phone numbers without the plus, cards in groups of another kind) and proposed
anew by the generators; counter-examples are the candidates that meet no base span, and
words of the documents put together like an address. A threshold per kind is
calibrated on the examples of odd hash, which training leaves out; a kind without both
sorts of examples gets no further span. The trees are compiled into one column
expression, so scoring happens inside a row: no Python, no explode, no shuffle.

All patterns run in time linear in the text: runs are possessive and a match can
only begin where a run begins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")
# Java forms of the base patterns; equal in what they match to the plain ones.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# High-recall generators.
WRITTEN = (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@| ?\(at\) ?| ?\[at\] ?| at )[A-Za-z0-9-]++"
           r"(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[A-Za-z0-9-]++)++")
DIGITS = r"(?<![0-9A-Za-z])[+(]{0,2}+[0-9](?:[ ().-]{0,2}+[0-9]){7,}+(?![0-9A-Za-z])"
CUES = r"(?i)(mail|contact|kontakt|correo|phone|tel|call|fon|móvil|tél|card|visa|karte|tarjeta|carte|addr|host|server|ip)"
PRECISION = 0.95
# What a counter-example that was put together from a document's words counts beside one that was found.
MADE_WEIGHT = 0.1
TREES, DEPTH = 8, 3
FEATURES = ("length", "digits", "separators", "dots", "groups", "luhn", "written", "cue", "digits_near", "letters_near",
            "last", "bracket", "name_marks")
# Code points kept on either side of a rewritten span; more than the features look at.
LEFT, RIGHT = 40, 20
# How an address is written out, by form.
AT, DOT = (" (at) ", " [at] ", " at "), (" (dot) ", " [dot] ", " dot ")


def find(text: Column, pattern: str, kind: int) -> Column:
    """Leftmost non-overlapping matches as ``array<struct<kind, start, end, value>>``; places in
    code points. What lies between the matches gives their places."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(m))
    pairs = F.zip_with(gaps, m, lambda g, v: F.struct(F.length(g).alias("g"), v.alias("v")))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)")
    zero = F.struct(F.lit(0).alias("at"), none.alias("found"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["g"]
        b = a + F.length(x["v"])
        one = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), x["v"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    return F.when(F.size(m) > 0, F.aggregate(pairs, zero, step, lambda acc: acc["found"])).otherwise(none)


def valid_ip(v: Column) -> Column:
    def small(p: Column) -> Column:
        d = F.regexp_replace(p, "^0+", "")
        return (F.length(d) <= 3) & (F.coalesce(d.try_cast("int"), F.lit(0)) <= 255)
    return F.forall(F.split(v, r"\."), small)


def only_digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def base_spans(text: Column) -> Column:
    """The base kinds' spans that pass their checks, by kind, then place."""
    def between(lo: int, hi: int):
        return lambda v: F.length(only_digits(v)).between(lo, hi)

    checks = {"email": None, "ip": valid_ip, "phone": between(8, 15),
              "card": lambda v: between(16, 19)(v) & F.call_function("luhn_check", only_digits(v))}
    out = []
    for i, k in enumerate(KINDS):
        got = find(text, BASE[k], i)
        out.append(passing(got, checks[k]) if checks[k] else got)
    return F.concat(*out)


def passing(spans: Column, check) -> Column:
    return F.filter(spans, lambda x: check(x["value"]))


def of_kind(spans: Column, kind: int) -> Column:
    return F.filter(spans, lambda x: x["kind"] == kind)


def candidates(text: Column) -> Column:
    """Proposed spans with their features as doubles, in :data:`FEATURES`' order."""
    proposed = F.concat(find(text, WRITTEN, 0), find(text, DIGITS, 1))

    def described(x: Column) -> Column:
        v, d = x["value"], only_digits(x["value"])
        n, dots = F.length(d), F.length(F.regexp_replace(x["value"], r"[^.]", ""))
        left = F.substr(text, F.greatest(x["start"] - 23, F.lit(1)), F.least(x["start"], F.lit(24)))
        right = F.substr(text, x["end"] + 1, F.lit(12))
        kind = F.when(x["kind"] == 0, 0).when((dots == 3) & ~v.rlike("[ ()+-]") & valid_ip(v), 1).when(n >= 13, 2).otherwise(3)
        near = F.concat(F.right(left, F.lit(12)), right)
        feats = [F.length(v), n, F.length(F.regexp_replace(v, r"[^ ().-]", "")), dots,
                 F.size(F.split(v, r"[^0-9A-Za-z]+", -1)), F.call_function("luhn_check", d).cast("int"),
                 v.rlike(r" |\(|\[").cast("int"), left.rlike(CUES).cast("int"),
                 F.length(only_digits(near)), F.length(F.regexp_replace(near, r"[^\p{L}]", "")),
                 F.length(F.regexp_extract(v, r"[A-Za-z0-9-]*$", 0)), v.rlike(r"[\[(]").cast("int"),
                 F.length(F.regexp_replace(F.regexp_extract(v, r"^[^ @(\[]*", 0), r"[^0-9._%+-]", ""))]
        return F.struct(kind.cast("int").alias("kind"), x["start"], x["end"],
                        F.array(*[F.coalesce(f.cast("double"), F.lit(0.0)) for f in feats]).alias("x"))

    return F.transform(proposed, described)


def meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def tree_column(node, x: Column) -> Column:
    """A fitted regression tree as nested conditions over ``x[feature]``."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(x[split.featureIndex()] <= float(split.threshold()), tree_column(node.leftChild(), x)).otherwise(
        tree_column(node.rightChild(), x))


class Model:
    """Boosted trees as a column function, and each kind's threshold."""

    def __init__(self, margin=None, thresholds: dict[int, float] | None = None):
        self.margin, self.thresholds = margin, thresholds or {}

    def accepts(self, c: Column) -> Column:
        if not self.thresholds:
            return F.lit(False)
        score = 1.0 / (1.0 + F.exp(-2.0 * self.margin(c["x"])))
        return reduce(lambda a, b: a | b, [(c["kind"] == k) & (score >= t) for k, t in self.thresholds.items()])


def rewritten(value: Column, kind: Column, form: Column) -> Column:
    """A base span's text in a form that the base rules miss (``form`` 0 to 2)."""
    def pick(options) -> Column:
        return F.element_at(F.array(*[F.lit(o) for o in options]), form + 1)

    host = F.substring_index(value, "@", -1)
    address = F.concat(F.substring_index(value, "@", 1), pick(AT), F.replace(host, F.lit("."), F.lit("|")))
    address = F.replace(address, F.lit("|"), pick(DOT))
    bare = F.regexp_replace(value, r"^\+", "")
    phone = F.when(form == 0, bare).when(form == 1, F.regexp_replace(bare, "[^0-9]+", " ")).otherwise(
        F.regexp_replace(bare, "[^0-9]+", "."))
    card = F.regexp_replace(only_digits(value), "([0-9]{4})(?=[0-9])", "$1|")
    card = F.replace(card, F.lit("|"), F.element_at(F.array(F.lit("."), F.lit("  "), F.lit(" - ")), form + 1))
    return F.when(kind == 0, address).when(kind == 3, phone).otherwise(card)


def examples(docs: DataFrame) -> DataFrame:
    """``kind, x, label, w, h`` of all examples and counter-examples from ``text`` rows; ``w`` is what
    an example counts."""
    text = F.col("text")
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,value:string>>)")
    both = docs.where(text.rlike(r"[0-9@]| at ")).select(
        text, F.coalesce(base_spans(text), none).alias("base"), candidates(text).alias("cand"))
    # Base spans, written another way where they stand.
    one = both.select("text", F.explode(F.filter("base", lambda b: b["kind"] != 1)).alias("b"))
    form = F.pmod(F.xxhash64("b.value", "b.start"), F.lit(3)).cast("int")
    from_ = F.greatest(F.col("b.start") - LEFT, F.lit(0))
    one = one.select(F.substr("text", from_ + 1, F.col("b.start") - from_).alias("left"),
                     rewritten(F.col("b.value"), F.col("b.kind"), form).alias("value"),
                     F.substr("text", F.col("b.end") + 1, F.lit(RIGHT)).alias("right"))
    one = one.select(F.length("left").alias("lo"), (F.length("left") + F.length("value")).alias("hi"),
                     F.concat("left", "value", "right").alias("text"))
    one = one.select("lo", "hi", candidates(F.col("text")).alias("cand"))
    good = one.select(F.explode(F.filter("cand", lambda c: (c["start"] < F.col("hi")) & (F.col("lo") < c["end"]))).alias("c"))
    # Candidates that meet no base span, and three words in a row put together like an address.
    found = both.select(F.explode(F.filter("cand", lambda c: ~F.exists("base", lambda b: meets(b, c)))).alias("c"))
    words = F.split(text, " ")
    at = (F.pmod(F.xxhash64("text"), F.greatest(F.size(words) - 11, F.lit(1))) + 1).cast("int")
    near = docs.select(F.slice(words, at, 11).alias("w")).where(F.size("w") == 11)
    made = F.concat(F.array_join(F.slice("w", 1, 4), " "), F.lit(" "), F.get("w", F.lit(4)), F.lit(" at "), F.get("w", F.lit(5)),
                    F.lit(" dot "), F.get("w", F.lit(6)), F.lit(" "), F.array_join(F.slice("w", 8, 4), " "))
    other = near.select(F.explode(F.filter(candidates(made), lambda c: c["kind"] == 0)).alias("c"))

    def marked(df: DataFrame, label: float, weight: float = 1.0) -> DataFrame:
        return df.select("c.kind", "c.x", F.lit(label).alias("label"), F.lit(weight).alias("w"),
                         F.xxhash64("c.x", "c.start").alias("h"))

    return marked(good, 1.0).unionByName(marked(found, 0.0)).unionByName(marked(other, 0.0, MADE_WEIGHT))


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Model:
    """Train on all examples and counter-examples of even hash (see :func:`examples`),
    calibrate on those of odd hash. Without both sorts the model adds nothing. A null text
    counts as empty; repeated rows count each; an empty table gives a model that adds nothing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    one = examples(docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    sample = written(one, "pii-examples")
    n = {(r.kind, r.label): r.n for r in sample.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = [k for k in range(len(KINDS)) if n.get((k, 0.0)) and n.get((k, 1.0))]
    if not kinds:
        return Model()
    used = sample.where(F.col("kind").isin(kinds))
    train = used.where("pmod(h, 2) = 0").select(array_to_vector("x").alias("features"), "label", "w")
    if train.select("label").distinct().count() < 2:
        return Model()
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, weightCol="w").fit(train)
    roots = [(w, m._java_obj.rootNode()) for w, m in zip(trees.treeWeights, trees.trees)]

    def margin(x: Column) -> Column:
        return reduce(lambda a, b: a + b, [F.lit(float(w)) * tree_column(r, x) for w, r in roots])

    # Weights of both labels in hundredths of the score; at most 404 rows.
    score = F.floor(100.0 / (1.0 + F.exp(-2.0 * margin(F.col("x"))))).cast("int")
    bins = (used.where("pmod(h, 2) = 1").groupBy("kind", score.alias("s"))
                .agg(F.sum(F.col("label") * F.col("w")).alias("pos"), F.sum("w").alias("n")).collect())
    thresholds = {}
    for k in kinds:
        pos = total = 0.0
        for r in sorted((r for r in bins if r.kind == k), key=lambda r: -r.s):
            pos, total = pos + r.pos, total + r.n
            if pos < precision * total:
                break
            thresholds[k] = r.s / 100.0
    return Model(margin, thresholds)


def spans_of(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` (``array<struct<kind, start, end, value>>``) and ``added``
    (``array<struct<kind, start, end>>``: accepted candidates that meet neither a base span
    nor an earlier accepted one). Column names of ``docs`` that clash are replaced."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    out = docs.withColumn("base", base_spans(t))
    none = F.expr("cast(array() as array<struct<kind:int,start:int,end:int>>)")
    if not model.thresholds:
        return out.withColumn("added", none)
    free = F.filter(F.filter(candidates(t), model.accepts),
                    lambda c: ~F.exists(F.col("base"), lambda b: meets(b, c)))
    flat = F.array_sort(F.transform(free, lambda c: F.struct(c["start"], c["end"], c["kind"])))
    keep = F.aggregate(flat, none, lambda acc, c: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > c["start"]), acc).otherwise(
            F.concat(acc, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))))
    return out.withColumn("added", keep)


def named(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans() -> Column:
    """Base and added spans by kind, then place."""
    short = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
    return F.array_sort(F.concat(F.transform("base", short), F.transform("added", short)))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row.

    A null text counts as empty (no spans); null and repeated ids keep their rows; an
    empty table gives no rows; other columns are ignored.
    """
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    got = spans_of(src, fit(src) if model is None else model)
    counts = [F.size(of_kind(F.col("base"), i)).cast("long").alias(f"n_{k}")
              for i, k in enumerate(KINDS)]
    return got.select("doc_id", *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"),
                      named(all_spans()).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its kind's mark, as ``[EMAIL]``.
    Overlapping spans become the mark of the one that begins first (the longer of two
    that begin together). A null text stays null; repeated rows stay, other columns are kept
    whatever their names, an empty table stays empty."""
    # Columns go by place, so none clashes with the spans'; each text is carried once.
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = place[text_col]
    src = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in place.items()])
    got = spans_of(src, fit(src, own) if model is None else model, own)
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    order = F.array_sort(F.transform(all_spans(), lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    none = F.expr("cast(array() as array<struct<gap:int,start:int,end:int,kind:int>>)")

    def step(acc: Column, s: Column) -> Column:
        at, end = F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0)), -s["back"]
        one = F.struct(at.alias("gap"), s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"))
        return F.when(s["start"] < at, acc).otherwise(F.concat(acc, F.array(one)))

    # Places first, then each piece of the text once, joined in one go.
    kept = F.aggregate(order, none, step)
    text = F.col(own)
    pieces = F.transform("kept", lambda s: F.concat(
        F.substr(text, s["gap"] + 1, s["start"] - s["gap"]), F.get(marks, s["kind"])))
    end = F.element_at("kept", -1)["end"]
    new = F.when(text.isNull() | (F.size("kept") == 0), text).otherwise(F.concat(
        F.array_join(pieces, ""), F.substr(text, end + 1, F.greatest(F.length(text) - end, F.lit(0)))))
    got = got.withColumn("kept", kept)
    return got.select(*[(new if c == text_col else F.col(n)).alias(c) for c, n in place.items()])
