"""Operators 1 and 8: ids against the tokenizers library, file round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from threadlens.llm import bitplane, bpe
from threadlens.llm.common import scratch

from .fixtures import awkward_docs

SPECIAL = ["", "  a  b\n\n c <|endoftext|> x\t\t y's I'll  ", "a" * 2000, " " * 50 + "x", "<|endoftext|>",
           "日本語 テキスト🙂 ½ ² x  y　z \u0085 q\x1c r", "aaa aaaa aaaaa ababab" * 20, "\n\n \n a", "1234567 12"]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(bpe.tokenizer_path())


def random_strings(n):
    rnd = random.Random(7)
    abc = "abcde  th\n\t'sé0.!🙂​"
    return ["".join(rnd.choice(abc) for _ in range(rnd.randint(0, 120))) for _ in range(n)]


def test_trie_ids_equal_the_library(reference):
    texts = SPECIAL + random_strings(500)
    own = bpe.Bpe(bpe.tokenizer_path())
    want = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # cold and with a filled cache
        got = [np.frombuffer(b, "<u4").tolist() for b in own.encode_batch(texts)]
        assert got == want
    assert [own.decode(np.array(w, "<u4").tobytes()) for w in want] == [
        reference.decode(w, skip_special_tokens=False) for w in want]


def test_chunked_library_encoder_equals_whole_texts(reference):
    texts = SPECIAL + random_strings(200)
    got = bitplane.Encoder(bpe.tokenizer_path()).batch(texts)
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [
        e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_encode_rows(spark, reference):
    docs = awkward_docs(spark)
    got = {(r.doc_id, r.decoded): (r.n_tokens, bytes(r.ids)) for r in bpe.encode(docs).collect()}
    for k, t in {(r.doc_id, r.text or "") for r in docs.collect()}:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert got[k, t] == (len(ids), np.array(ids, "<u4").tobytes())
    assert bpe.encode(docs).count() == docs.count()
    digests = {r.doc_id: r for r in bpe.encode_digests(docs).collect()}
    assert digests[2].n_tokens == 0 and digests[2].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_segment_round_trip(kind):
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000, 70_000):
        for top in (1, 2, 300, 50_257, 1 << 32):
            ids = rnd.integers(0, top, n, dtype=np.uint64).astype("<u4")
            seg = bitplane.Segment(bitplane.pack_segment([5, None], [n, 0], ids, 3, 4, kind, 1 << 14) + b"\n")
            assert (seg.ids() == ids).all() and (seg.part, seg.seq, seg.kind) == (3, 4, kind)
            if n > 1 << 14:
                assert (seg.block(1) == ids[1 << 14:2 << 14]).all()


def test_token_files(spark, reference, tmp_path):
    docs = awkward_docs(spark).repartition(3)
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    got = sorted(bitplane.token_files(docs, segment=500, block=64).collect(), key=lambda r: r.start)
    start = 0
    for (k, t), r in zip(rows, got, strict=True):
        ids = np.array([*reference.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (k, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    path = scratch(spark, "t")
    bitplane.write_tokens(docs, path, kind="byte")
    back = bitplane.read_tokens(spark, path).where("doc_id = 8").first()
    assert np.frombuffer(back.ids, "<u4").tolist() == [*reference.encode(
        "é ñ 日本語 🙂 a@b.c", add_special_tokens=False).ids, 0]
    assert bitplane.token_files(docs.limit(0)).count() == 0
