"""BPE encoding and decoding by prefix-sharing trie traversal (operator 8).

The distinct words of a batch form a trie. A depth-first walk carries one state
per node: the last token of the encoding of the node's path. A node's state
follows from its ancestors' (the token that ends there and may stand after the
last token of the path before it), so the encoding of a prefix shared by many
words is worked out once. A word's ids are read back from its node to the root.

Two tokens may stand side by side if and only if no merge across their border
comes before the merges that build them; :meth:`Bpe.fits` checks that along the
right edge of one and the left edge of the other. A sequence of tokens is the
BPE encoding of its bytes exactly when all neighbours fit, hence one token fits
at each node.

Everything is row-local: no shuffle, no broadcast but the vocabulary path.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import pick, slices_by_bytes, worker_state
from .ragged import WINDOW_BYTES, PieceStore, binary_array, flat, gather, ids_of_pieces, sums, unpacked, windows

# Checks of token pairs kept by a worker before they are dropped and made anew (memory only).
CACHE_PAIRS = 300_000

OUT = ("doc_id long, n_tokens long, ids binary, decoded string")
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for code points from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizer file, with its word cache."""

    def __init__(self, path: str):
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") \
                or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without prefix space and normalizer is needed")
        # Fixed value: the word pattern of the byte-level pre-tokenizer.
        self.words = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        alphabet = byte_symbols()
        raw = lambda s: bytes(alphabet[c] for c in s)
        self.vocab: dict[bytes, int] = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.text_of: dict[int, bytes] = {i: t for t, i in self.vocab.items()}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.text_of.update({i: c.encode() for c, i in self.added.items()})
        self.split_added = re.compile("(" + "|".join(map(re.escape, self.added)) + ")").split if self.added else None
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            x, y = self.vocab[raw(a)], self.vocab[raw(b)]
            self.rank[x, y] = r
            self.parts.setdefault(self.vocab[raw(a + b)], (x, y))
        self.longest: dict[bytes, int] = {}
        for t in self.vocab:
            self.longest[t[-2:]] = max(self.longest.get(t[-2:], 0), len(t))
        self.edges: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.fit: dict[tuple[int, int], bool] = {}
        self.store = PieceStore(self.fresh)
        said = [self.text_of.get(i, b"") for i in range(max(self.text_of) + 2)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_size = np.array([len(x) for x in said], np.int64)
        self.said_at = sums(self.said_size)[:-1]

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens at one edge of ``token`` while it is built, first to last, each with
        the rank of the merge that replaces it (side 1: right edge, 0: left edge)."""
        key = token, side
        if key not in self.edges:
            up, t = [(token, float("inf"))], token
            while t in self.parts:
                pair = self.parts[t]
                t = pair[side]
                up.append((t, self.rank[pair]))
            self.edges[key] = up[::-1]
        return self.edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left right`` is how BPE writes their joined bytes."""
        key = left, right
        if key in self.fit:
            return self.fit[key]
        a, b, i, j, ok = self.edge(left, 1), self.edge(right, 0), 0, 0, True
        while True:
            (x, nx), (y, ny) = a[i], b[j]
            cross = self.rank.get((x, y))
            # Of equal ranks the leftmost merge goes first.
            if cross is not None and cross < nx and cross <= ny:
                ok = False
                break
            if nx <= ny:
                if i + 1 == len(a):
                    break
                i += 1
            else:
                j += 1
        if len(self.fit) > CACHE_PAIRS:
            self.fit.clear()
        self.fit[key] = ok
        return ok

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words. Sorted words are the trie in depth-first order;
        ``state`` holds the last token of every node on the current path."""
        vocab, longest, fits = self.vocab, self.longest, self.fits
        out: dict[bytes, list[int]] = {}
        fit = self.fit.get
        state: list[int] = []
        size: list[int] = []
        before = b""
        for w in sorted(words):
            n = 0
            for x, y in zip(before, w):
                if x != y:
                    break
                n += 1
            del state[n:], size[n:]
            for i in range(n, len(w)):
                end = i + 1
                for k in range(min(end, longest.get(w[max(0, i - 1):end], 1)), 0, -1):
                    t = vocab.get(w[end - k:end])
                    if t is not None and (k == end or fit((state[i - k], t), None) or fits(state[i - k], t)):
                        break
                state.append(t)
                size.append(k)
            before, i, ids = w, len(w), []
            while i:
                ids.append(state[i - 1])
                i -= size[i - 1]
            out[w] = ids[::-1]
        return out

    def fresh(self, parts: list[bytes]):
        """``(ids, sizes)`` of distinct pieces of text."""
        split: list[list[bytes]] = []
        for p in parts:
            t = p.decode("utf-8", "replace")
            if t.isalpha() or (t[:1] == " " and t[1:].isalpha()):
                split.append([p])
            elif self.split_added is not None and any(a in t for a in self.added):
                split.append([w.encode() for x in self.split_added(t)
                              for w in ([x] if x in self.added else self.words(x))])
            else:
                split.append([w.encode() for w in self.words(t)])
        packed = {a.encode(): struct.pack("<I", i) for a, i in self.added.items()}
        new = self.encode_words(list(set().union(*split).difference(packed)))
        packed |= {w: struct.pack(f"<{len(t)}I", *t) for w, t in new.items()}
        return unpacked([packed[ws[0]] if len(ws) == 1 else b"".join([packed[w] for w in ws]) for ws in split])

    def encode_flat(self, offsets, data):
        """``(token offsets, ids)`` of a slice of texts."""
        return encode_flat(offsets, data, list(self.added), self.store)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        at, ids = self.encode_flat(*flat(pa.array(texts, pa.string())))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(at, at[1:])]

    def decode_flat(self, offsets, ids):
        """``(byte offsets, bytes)`` of the texts of rows of ids. Unknown ids say nothing."""
        import numpy as np

        ids = np.minimum(ids, len(self.said_size) - 1)
        sizes = self.said_size[ids]
        at = sums(sizes)
        out = [gather(self.said, self.said_at[ids[lo:hi]], sizes[lo:hi]) for lo, hi in windows(at)]
        return at[offsets], np.concatenate([np.zeros(0, np.uint8), *out])

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become U+FFFD. Unknown ids give nothing."""
        import numpy as np

        own = np.frombuffer(ids, "<u4")
        return self.decode_flat(np.array([0, len(own)]), own)[1].tobytes().decode("utf-8", "replace")


# Marks that end a run of letters (no apostrophe: it may begin a word of its own kind).
MARKS = b".,;:!?"


def word_cuts(offsets, data):
    """Places at which the byte-level pre-tokenizer surely begins a word, so that a text's ids are
    those of its pieces in a row: before an ASCII blank after anything but a blank, after
    a lone ASCII blank that is no space (words begin with one space at most), and before a mark
    after an ASCII letter. Near what may be a blank outside ASCII no cut is made."""
    import numpy as np

    n = len(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = cut[n] = True
    if n < 2:
        return cut
    kind = np.zeros(256, np.uint8)  # 1 blank, 2 other control that some call blank, 4 letter, 8 mark
    kind[[0x20, *range(0x09, 0x0E)]] = 1
    kind[0x1C:0x20] = 2
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 4
    kind[list(MARKS)] = 8
    of = kind[data]
    # Characters from 0x80 on that may be blanks: two or three bytes with these beginnings.
    two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    three = (data[:-1] >= 0xE1) & (data[:-1] <= 0xE3) & np.isin(data[1:], (0x80, 0x81, 0x9A, 0xA0))
    solid_end = of & 3 == 0  # the character that ends here is no blank
    solid_end[1:] &= ~two
    solid_end[2:] &= ~three[:-1]
    solid_start = of & 3 == 0
    solid_start[:-1] &= ~(two | three)
    blank = of & 1 == 1
    before = blank[1:] & solid_end[:-1]
    letter = of == 4
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # no times and division signs
    cut[1:n] |= before | ((of[1:] == 8) & letter[:-1])
    cut[2:n] |= before[:-1] & (data[1:-1] != 0x20) & solid_start[2:]
    return cut


def encode_flat(offsets, data, added: list[str], store: PieceStore):
    """``(token offsets, ids)`` of texts by way of their distinct pieces. A text with an added
    token's string, which may span a cut, is one piece."""
    import numpy as np

    cut = word_cuts(offsets, data)
    raw = data.tobytes()
    for a in added:
        a = a.encode()
        i = raw.find(a)
        while i >= 0:
            row = int(np.searchsorted(offsets, i, "right")) - 1
            cut[offsets[row] + 1:offsets[row + 1]] = False
            i = raw.find(a, max(i + 1, int(offsets[row + 1]) - len(a)))
    cuts = np.flatnonzero(cut)
    if not len(data):
        return np.zeros(len(offsets), np.int64), np.zeros(0, "<u4")
    ids, sizes = ids_of_pieces(data, cuts, store)
    return sums(sizes)[np.searchsorted(cuts, offsets)], ids


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str | None) -> Bpe:
    return worker_state(f"bpe:{path}", lambda: Bpe(path or tokenizer_path()))


def _run(docs: DataFrame, id_col: str, text_col: str, path: str | None, schema: str) -> DataFrame:
    digest = schema == DIGEST

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bpe = load(path)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for part in slices_by_bytes(batch, 1, WINDOW_BYTES):
                at, ids = bpe.encode_flat(*flat(part.column(1)))
                where, text = bpe.decode_flat(at, ids)
                raw, said, n = ids.astype("<u4").tobytes(), text.tobytes(), len(part)
                said = [said[where[i]:where[i + 1]].decode("utf-8", "replace") for i in range(n)]
                if digest:
                    cols = [pa.array([hashlib.sha256(raw[4 * at[i]:4 * at[i + 1]]).hexdigest() for i in range(n)]),
                            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in said])]
                else:
                    cols = [binary_array(4 * at, ids.astype("<u4").view("u1"), pa.binary()), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(at[1:] - at[:-1], pa.int64()), *cols],
                                                 names=names)

    src = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    return src.mapInArrow(work, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           path: str | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` are little-endian unsigned 32-bit integers; ``decoded`` is the text of
    the ids, special tokens kept. A null text counts as empty (no ids, empty
    decoded text); a null ``doc_id`` stays null; repeated rows stay repeated; an
    empty table gives an empty result; other columns are ignored. A special
    token's own string in a text becomes its id, as in the tokenizer file.
    ``path`` must exist on every executor (default: the public 50k byte-level BPE).
    """
    return _run(docs, id_col, text_col, path, OUT)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   path: str | None = None) -> DataFrame:
    """:func:`encode` with sha256 digests in place of the ids and the decoded text,
    made where the ids are, so neither leaves the task."""
    return _run(docs, id_col, text_col, path, DIGEST)
