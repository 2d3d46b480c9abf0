"""Operators 6 and 10 against brute force."""

import collections
import hashlib
import re

import pytest

from threadlens.llm import decontam, suffix_dedup

from .fixtures import awkward_docs, random_texts


def brute_removed(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        cov = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                cov[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if cov[i] and (i == 0 or not cov[i - 1]))
        out.append((len(b), sum(cov), spans, hashlib.sha256(bytes(x for x, y in zip(b, cov) if not y)).hexdigest()))
    return out


@pytest.mark.parametrize("length", [30, 100])
def test_repeats(spark, length):
    texts = random_texts(120) + ["", None, "a" * 300, "ab" * 200, "x" * 30, "a" * 29]
    texts += [texts[3], texts[3], None]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)],
                               "doc_id long, text string, c int, at int").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(df, length=length).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts, length)


def test_repeat_rows(spark):
    docs = awkward_docs(spark)
    got = suffix_dedup.remove_repeats(docs, length=40, with_text=True).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[1].n_removed == by[1].n_bytes and bytes(by[1].kept) == b"" and by[2].n_bytes == 0
    assert bytes(by[8].kept).decode() == "é ñ 日本語 🙂 a@b.c" and by[None].n_removed == 0
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_minimizers_over_chunk_borders():
    data = "".join(random_texts(30, 5)).encode()
    whole = suffix_dedup.minimizers(data, 30).tolist()
    assert suffix_dedup.minimizers(data, 30, chunk=17).tolist() == whole
    assert [lo for lo, _, _ in whole[1:]] == [hi + 1 for _, hi, _ in whole[:-1]]


WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))


def brute_hits(doc, items, size=10):
    w, hit, own = words(doc), set(), set()
    for k, t in items:
        x = words(t)
        wins = {tuple(x[i:i + size]) for i in range(max(1, len(x) - size + 1))} if x else ()
        for win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i:i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    own.add(k)
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block_words", [400_000, 1500])
def test_contamination(spark, block_words):
    base = random_texts(40, 9)
    items = [(i, t) for i, t in enumerate(base[:12])] + [(50, None), (51, ""), (52, "!!"), (53, "Quick Brown"),
                                                         (54, "lorem-IPSUM dolor"), (55, base[0]), (55, base[0])]
    docs = awkward_docs(spark, extra=[(100 + i, (base[i] + " x " + base[(i * 7) % 40]).upper() if i % 2 else base[i])
                                      for i in range(40)])
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, win int")
    got = decontam.contamination(docs, bench, block_words=block_words).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for r in docs.collect():
        want = brute_hits(r.text, items)
        g = by[r.doc_id]
        assert (g.n_words, g.n_hit, sorted(g["items"])) == want
        assert sum(x.end - x.start for x in g.spans) == g.n_hit
    assert decontam.clean(docs, bench).count() == sum(1 for r in got if r.n_hit == 0)
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_planted_passages_of_over_fifty_words(spark):
    """Passages that repeat across documents go whole if they have 400 bytes or more, as the rule
    says; shorter ones stay, whatever their words. Clean documents are left alone."""
    import random

    rnd = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def word(n=None):
        return "".join(rnd.choice(letters) for _ in range(n or rnd.randint(2, 9)))

    rows, planted = [], []
    for i in range(40):
        size = 3 if i % 4 == 0 else None  # 51 words of three letters are 203 bytes
        passage = " ".join(word(size) for _ in range(rnd.randint(51, 90)))
        planted.append(len(passage))
        for side in range(2):
            rows.append((2 * i + side, " ".join(word() for _ in range(30)) + f"\n{passage}\n" + " ".join(word() for _ in range(30))))
    rows += [(100 + i, " ".join(word() for _ in range(120))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(df).collect()}
    long = [i for i, n in enumerate(planted) if n >= 400]
    short = [i for i, n in enumerate(planted) if n < 390]
    assert len(long) >= 5 and len(short) >= 5
    assert all(got[2 * i + s] >= planted[i] for i in long for s in range(2))
    assert all(got[2 * i + s] == 0 for i in short for s in range(2))
    assert all(got[100 + i] == 0 for i in range(30))
