"""Operator 7: base spans against plain patterns, additions, redaction."""

import random
import re

from pyspark.sql import functions as F

from threadlens.llm import pii

from .fixtures import awkward_docs


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain(t):
    t = t or ""
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_base_spans(spark):
    rnd = random.Random(5)
    bits = ["a", "@", ".", "1", "23", "4", "-", " ", "+", "(", ")", "é", "😀", "b.c", "_", "255", "x@y.z",
            "4539 1488 0343 6467", "+1 (234) 555-1234"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += [None, "", "1" * 30_000, "a" * 30_000 + "@", "1 " * 20_000, "+1" + "(" * 20_000, "1." * 20_000,
              "a.b_c@" * 5_000, "x@y.z " * 500]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = pii.spans_of(df, pii.Model()).select("text", pii.named(F.col("base")).alias("b")).collect()
    for r in got:
        assert r.b == plain(r.text)


def test_rows_and_redaction(spark):
    docs = awkward_docs(spark, extra=[(30, "Call +1 (234) 555-1234 or a.b@c.de, 1.2.3.4!")])
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    assert tuple(got[30])[1:5] == (1, 1, 0, 1) and got[2].spans == "" and got[8].n_email == 1
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[30] == "Call [PHONE] or [EMAIL], [IP]!" and text[2] is None and text[8].endswith("🙂 [EMAIL]")
    assert pii.detect(docs.limit(0)).count() == 0


def test_model_adds_only_beside_base_spans(spark):
    rows = [(i, f"Tel +1 (234) 555-{1000 + i} ok. Mail u{i}@h.example now. Ref 20{i:02d} 1{i:03d} 77{i:02d}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    got = pii.spans_of(docs, model).select(pii.named(F.col("base")).alias("b"), pii.named(pii.all_spans()).alias("a"))
    for r in got.collect():
        assert set(r.b.split(",")) <= set(r.a.split(","))


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.detect(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def prose(rnd, n):
    return " ".join(rnd.choice(["order", "the", "cat", "sat", "walk", "green", "river", "look", "seven", "house"]) for _ in range(n))


def test_model_adds_written_forms(spark):
    """Forms that the base rules miss are found, and other numbers and prose are left alone."""
    rnd = random.Random(8)
    rows = []
    for i in range(600):
        host = rnd.choice(["example.com", "mail.org", "uni.edu", "post.net"])
        kind = i % 4
        say = {0: f"Contact {rnd.choice('abc')}{i}.doe@{host} please", 1: f"Tel +1 (234) 555-{1000 + i} today",
               2: f"Order 20{i % 90 + 10} {1000 + i} {7000 + i} shipped", 3: f"Card 4111 1111 1111 1111 kept"}[kind]
        rows.append((i, f"{prose(rnd, 12)}. {say}. {prose(rnd, 12)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.fit(docs)
    planted = [f"{prose(rnd, 6)}. Contact {u} please. {prose(rnd, 6)}" for u in
               ("john.doe (at) example (dot) com", "anna7 at mail dot org", "k.m [at] uni [dot] edu", "b5.doe (at) post (dot) net")]
    planted += [f"{prose(rnd, 6)}. Tel {u} today. {prose(rnd, 6)}" for u in
                ("1 (234) 555-9876", "1 234 555 4321", "1.234.555.2468", "1 (234) 555-1357")]
    clean = [f"{prose(rnd, 30)}" for _ in range(20)] + [f"{prose(rnd, 5)} cat at house dot river {prose(rnd, 5)}"] + \
            [f"{prose(rnd, 5)}. Order 20{i} {2000 + i} {8000 + i} shipped. {prose(rnd, 5)}" for i in range(10, 30)]
    new = spark.createDataFrame([(i, t) for i, t in enumerate(planted + clean)], "doc_id long, text string")
    got = {r.doc_id: r.added for r in pii.spans_of(new, model).select("doc_id", "added").collect()}
    caught = sum(bool(got[i]) for i in range(len(planted)))
    assert caught >= 0.9 * len(planted), [t for i, t in enumerate(planted) if not got[i]]
    spared = sum(not got[len(planted) + i] for i in range(len(clean)))
    assert spared >= 0.95 * len(clean)
    # Without the trees nothing is added.
    assert all(not r.added for r in pii.spans_of(new, pii.Model()).collect())


def test_long_addresses_are_whole(spark):
    host = " dot ".join(["part"] * 12)
    text = f"mail {'u' * 90} at {host} now"
    got = spark.createDataFrame([(text,)], "text string").select(pii.candidates(F.col("text")).alias("c")).first().c
    assert [(c.start, c.end) for c in got] == [(5, len(text) - 4)]


def test_every_document_gives_its_examples(spark):
    rows = [(f"house walk river green seven mail user{i}@example.com the cat sat look order",) for i in range(60)]
    got = pii.examples(spark.createDataFrame(rows, "text string"))
    n = {(r.label, r.w): r["count"] for r in got.groupBy("label", "w").count().collect()}
    assert n[(1.0, 1.0)] == 60 and n[(0.0, pii.MADE_WEIGHT)] == 60
