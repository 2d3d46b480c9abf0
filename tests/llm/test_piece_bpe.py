"""Operator 11: ids and decoded texts against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from threadlens.llm import piece_bpe
from threadlens.llm.ragged import flat

from .fixtures import awkward_docs

ATOMS = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "🙂", "▁", "<s>", "</s>", "<0x0A>", "<unk>", "ing", "er",
         "1", "0", "…", "ß", " " * 14, " ⁇ ", "\x00", "\x1c", "\u0085", "　", "�"]
SPECIAL = ["", None, " ", "  ", "▁", "▁▁ ▁ a", " " * 100 + "x" + " " * 77, "a" * 5000, "ab" * 9000, "日本語テキスト" * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceBpe(piece_bpe.model_path())


def both_ways(model, texts):
    at, ids = model.encode_flat(*flat(pa.array(texts, pa.string())))
    where, said = model.decode_flat(at, ids)
    said = said.tobytes()
    return ([ids[a:b].tolist() for a, b in zip(at, at[1:])],
            [said[a:b].decode() for a, b in zip(where, where[1:])])


def test_equals_the_library(model, library):
    rnd = random.Random(1)
    texts = SPECIAL + ["".join(rnd.choice(ATOMS) for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    for _ in range(2):  # cold and with a filled cache
        ids, said = both_ways(model, texts)
        assert ids == want
        assert said == library.decode(want)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_equals_the_library_on_any_text(texts):
    own = piece_bpe.load(None)
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.model_path())
    want = [lib.encode(t, add_bos=True, add_eos=True) for t in texts]
    assert both_ways(own, texts) == (want, [lib.decode(w) for w in want])


def test_backtracking_gives_a_piece_back(model):
    """Longest matches alone are not the encoding: some words need shorter pieces."""
    rnd = random.Random(3)
    longest = 0
    for _ in range(2000):
        text = "▁" + "".join(rnd.choice(["in", "ing", "er", "re", "th", "the", "s", "t", "on", "a"]) for _ in range(4))
        row = model.backtrack(text)
        assert [model.text[i] for i in row] == model.merge(text)
        at, first, i = model.matches(text), [], 0
        while i < len(text):
            first.append(at[i][-1] if at[i] else model.character(text[i]))
            i += model.size[first[-1]]
        longest += first == row
    assert 0 < longest < 2000


def test_long_piece_is_matched_in_spans(model, library, monkeypatch):
    monkeypatch.setattr(piece_bpe, "SPAN", 7)
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(["in", "ing", "er", "▁", "é", "日", "the", "  "]) for _ in range(50)) for _ in range(50)]
    assert both_ways(model, texts)[0] == library.encode(texts, add_bos=True, add_eos=True)


def test_windows_within_a_text(library, monkeypatch):
    from threadlens.llm import ragged

    own = piece_bpe.PieceBpe(piece_bpe.model_path())
    monkeypatch.setattr(ragged.windows, "__defaults__", (16,))
    monkeypatch.setattr(ragged.ids_of_pieces, "__defaults__", (16,))
    monkeypatch.setattr(piece_bpe, "WINDOW_BYTES", 16)
    texts = SPECIAL + ["one two  three\nfour " * 20]
    want = library.encode([t or "" for t in texts], add_bos=True, add_eos=True)
    assert both_ways(own, texts) == (want, library.decode(want))


def test_rows(spark, library):
    docs = awkward_docs(spark)
    got = {(r.doc_id, r.decoded): (r.n_tokens, bytes(r.ids)) for r in piece_bpe.encode(docs).collect()}
    digests = {(r.doc_id, r.decoded_sha256): r for r in piece_bpe.encode_digests(docs).collect()}
    for k, t in {(r.doc_id, r.text or "") for r in docs.collect()}:
        ids = library.encode(t, add_bos=True, add_eos=True)
        said = library.decode(ids)
        assert got[k, said] == (len(ids), np.array(ids, "<u4").tobytes())
        row = digests[k, hashlib.sha256(said.encode()).hexdigest()]
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert piece_bpe.encode(docs).count() == docs.count()
    assert piece_bpe.encode_digests(docs.limit(0)).count() == 0


def test_decode_any_ids(spark, library):
    rows = [(1, [259, 3, 4, 0xFF + 3, 262, 0, 259]), (2, []), (3, [1, 1, 2]), (4, [1, 29871, 29871, 262]), (5, None),
            (6, [0xE6 + 3, 0xBC + 3, 262, 0xA2 + 3])]
    df = spark.createDataFrame([(k, None if v is None else bytearray(np.array(v, "<u4").tobytes())) for k, v in rows],
                               "doc_id long, ids binary")
    got = {r.doc_id: r.decoded for r in piece_bpe.decode(df).collect()}
    assert got == {k: library.decode(v or []) for k, v in rows}
