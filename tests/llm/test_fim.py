"""Operator 13: against a regular-expression version, and the rotations both ways."""

import hashlib
import random
import re

import pytest

from threadlens.llm import fim

from .fixtures import awkward_docs

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def expected(doc_id, text, seed=42, rate=50, spm_rate=80):
    text = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(x[8 * i:8 * i + 8], 16) for i in range(4))
    w = TOKEN.findall(text)
    n = len(w)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    p, m, s = "".join(w[:a]), "".join(w[a:b]), "".join(w[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in df.collect()), key=repr)


@pytest.mark.parametrize("kw", [{}, {"seed": 7, "rate": 100, "spm_rate": 0}, {"rate": 100, "spm_rate": 100}])
def test_equals_brute_force(spark, kw):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab é\n\t日🙂\x0b\x0c\r\x1c <PSM>") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    texts += ["", " ", "\n \t", " x", "x ", "<P>", "a<S>b c", "<M", "x" * 50_000 + " y" * 20_000, None]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string").repartition(3)
    got = rows_of(fim.transform(docs, **kw))
    assert got == sorted(((k, *expected(k, t, **kw)) for k, t in enumerate(texts, 100)), key=repr)
    assert {f for _, _, f, *_ in got} >= ({"plain", "spm"} if not kw.get("spm_rate") == 0 else {"plain", "psm"})


def test_restored_text_is_exact(spark):
    docs = awkward_docs(spark)
    got = fim.restore(fim.transform(docs, rate=100, spm_rate=50)).collect()
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.restored) for r in got), key=repr) == want


def test_awkward_rows(spark):
    docs = awkward_docs(spark)
    want = sorted(((r.doc_id, *expected(r.doc_id, r.text)) for r in docs.collect()), key=repr)
    assert rows_of(fim.transform(docs)) == want
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


def test_restore_keeps_other_columns(spark):
    rows = spark.createDataFrame([("<S>c<P>a<M>b", "spm", 1, "old"), (None, None, 2, "x"), ("t", "what", 3, "")],
                                 "output string, form string, `a.b` int, restored string")
    got = fim.restore(rows)
    assert got.columns == ["output", "form", "a.b", "restored"]
    assert [(r["a.b"], r.restored) for r in got.orderBy("`a.b`").collect()] == [(1, "abc"), (2, ""), (3, "t")]


def test_rotation_inverts():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(0, 40)
        raw = bytes(rnd.randrange(256) for _ in range(n))
        lo, mid, hi = sorted(rnd.randint(0, n) for _ in range(3))
        buf = bytearray(raw)
        fim.rotate(buf, lo, mid, hi)
        assert bytes(buf) == raw[:lo] + raw[mid:hi] + raw[lo:mid] + raw[hi:]
        fim.rotate(buf, lo, lo + hi - mid, hi)
        assert bytes(buf) == raw
