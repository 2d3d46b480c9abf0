"""SentencePiece BPE encoding by backtracking, and decoding (operator 11).

A merge-type vocabulary joins neighbouring symbols whose joined string is a piece, the
highest score first, the leftmost of equals. A row of pieces is the encoding of its text
exactly when every two neighbours are: merging the two pieces' text anew must give just
these two. (Up to the first merge across a border, merges on both sides of it go as they
would in the two pieces alone, since scores and places compare alike there.) Hence the
encoding is found without merging the text: Aho-Corasick gives the pieces that begin at
every place, the longest that fits its left neighbour is taken, and where none fits the
place is marked in a bitfield and the last piece is given back for a shorter one.

Texts are cut where no piece can span: between two characters that no piece has side by
side (so before nearly every space). Distinct pieces of text are encoded once for a window;
the rest is numpy on Arrow buffers. Row-local: no shuffle, no broadcast but the vocabulary's path.
"""

from __future__ import annotations

import codecs
import hashlib
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import pick, slices_by_bytes, worker_state
from .ragged import WINDOW_BYTES, PieceStore, binary_array, flat, gather, ids_of_pieces, sums, unpacked, windows

MARK = "▁"
# Kinds of pieces in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
# Characters of a long piece of text whose matches are held at a time.
SPAN = 4_096
# Pair checks and merges kept by a worker.
CACHE_PAIRS = 300_000

OUT = "doc_id long, n_tokens long, ids binary, decoded string"
DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """``(number, value)`` of a protocol-buffer message: integers, floats or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value = struct.unpack("<d" if n == 8 else "<f", data[at:at + n])[0]
            at += n
        else:
            n = number()
            value = data[at:at + n]
            at += n
        yield key >> 3, value


class Bitfield:
    """A set of places in a text, one bit each."""

    def __init__(self, n: int):
        self.bits = bytearray(n // 8 + 1)

    def add(self, i: int) -> None:
        self.bits[i >> 3] |= 1 << (i & 7)

    def __contains__(self, i: int) -> bool:
        return bool(self.bits[i >> 3] >> (i & 7) & 1)


class PieceBpe:
    """A merge-type model file: vocabulary, encoder and decoder."""

    def __init__(self, path: str):
        import ahocorasick
        import numpy as np

        kinds: list[int] = []
        self.pieces: list[str] = []
        scores: list[float] = []
        trainer: dict = {}
        normal: dict = {}
        denormal: dict = {}
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                if number == 1:
                    p = dict(fields(value))
                    self.pieces.append(p[1].decode())
                    scores.append(p.get(2, 0.0))
                    kinds.append(p.get(3, NORMAL))
                elif number == 2:
                    trainer = dict(fields(value))
                elif number == 3:
                    normal = dict(fields(value))
                elif number == 5:
                    denormal = dict(fields(value))
        plain = not normal.get(2) and not normal.get(4, 1) and normal.get(5, 1) and not denormal.get(2)
        if trainer.get(3) != 2 or not plain or trainer.get(24) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("a BPE model with identity normalisation and no user-defined pieces is needed")
        self.dummy = bool(normal.get(3, 1))
        self.score = {p: s for p, s, k in zip(self.pieces, scores, kinds) if k == NORMAL}
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == NORMAL}
        self.bos = self.pieces.index(trainer.get(46, b"<s>").decode())
        self.eos = self.pieces.index(trainer.get(47, b"</s>").decode())
        self.unk = kinds.index(UNKNOWN)
        self.byte = [self.unk] * 256
        for i, (p, k) in enumerate(zip(self.pieces, kinds)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
        self.fallback = bool(trainer.get(35, 0)) and BYTE in kinds
        # Single characters are no matches: each is the last resort at its place. One that is no
        # piece gets a number past the vocabulary's.
        self.matcher = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) > 1:
                self.matcher.add_word(p, i)
        self.matcher.make_automaton()
        self.longest = max(map(len, self.id))
        self.text = list(self.pieces)
        self.size = [len(p) for p in self.pieces]
        self.single = {p: i for p, i in self.id.items() if len(p) == 1}
        # Characters (last byte of one, first byte of the next) that stand side by side in a piece.
        self.joined = np.zeros((256, 256), bool)
        forms = {c: [x.encode() for x in ((c, " ") if c == MARK else (c,))] for c in set("".join(self.id))}
        for x, y in {p[i:i + 2] for p in self.id for i in range(len(p) - 1)}:
            for a in forms[x]:
                for b in forms[y]:
                    self.joined[a[-1], b[0]] = True
        # Bytes that each id stands for in a decoded text.
        unknown = trainer.get(44, " ⁇ ".encode())
        text = {NORMAL: lambda p: p.replace(MARK, " ").encode(), UNKNOWN: lambda p: unknown,
                CONTROL: lambda p: b"", BYTE: lambda p: bytes([int(p[3:5], 16)])}
        said = [text[k](p) for p, k in zip(self.pieces, kinds)]
        self.said = np.frombuffer(b"".join(said), np.uint8)
        self.said_size = np.array([len(x) for x in said], np.int64)
        self.said_at = sums(self.said_size)[:-1]
        self.marked = np.array([p.startswith(MARK) and k == NORMAL for p, k in zip(self.pieces, kinds)])
        self.control = np.array([k == CONTROL for k in kinds])
        self.pairs: dict[int | None, dict[int, bool]] = {}
        self.n_pairs = 0
        self.store = PieceStore(self.fresh)

    def merge(self, text: str) -> list[str]:
        """Merging as the model defines it; only ever given one or two pieces' text."""
        row, score = list(text), self.score.get
        while len(row) > 1:
            best, at = None, -1
            for i in range(len(row) - 1):
                s = score(row[i] + row[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            row[at:at + 2] = [row[at] + row[at + 1]]
        return row

    def fits(self, left: int | None, right: int) -> bool:
        """Whether piece ``right`` may follow piece ``left`` (None: begin a text)."""
        if self.n_pairs > CACHE_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        own = [self.text[i] for i in ((right,) if left is None else (left, right))]
        ok = self.pairs.setdefault(left, {})[right] = self.merge("".join(own)) == own
        return ok

    def character(self, c: str) -> int:
        """The number of a single character."""
        i = self.single.get(c)
        if i is None:
            i = self.single[c] = len(self.text)
            self.text.append(c)
            self.size.append(1)
        return i

    def matches(self, text: str, lo: int = 0, hi: int | None = None) -> list[list[int]]:
        """Pieces of two characters and more that begin at each place from ``lo`` to ``hi``, shortest first."""
        hi = len(text) if hi is None else hi
        out: list[list[int]] = [[] for _ in range(hi - lo)]
        size, last = self.size, hi - lo
        for end, i in self.matcher.iter(text, lo, min(len(text), hi + self.longest - 1)):
            at = end - size[i] + 1 - lo
            if at < last:
                out[at].append(i)
        return out

    def backtrack(self, text: str) -> list[int]:
        """Numbers of the pieces of ``text`` (word marks in place of spaces, not empty). Matches
        are found a span at a time, so a long text needs no list of its own length."""
        pairs, fits, size, character = self.pairs, self.fits, self.size, self.character
        whole = len(text)
        failed = Bitfield(whole + 1)
        dead = False  # whether any place is marked
        row: list[int] = []
        taken: list[int] = []  # which of a place's matches each piece of the row is; -1: the character
        lo = hi = pos = 0
        k = None
        own: dict = pairs.get(None, {})
        left = None
        while pos < whole:
            if not lo <= pos < hi:
                lo = pos - pos % SPAN
                hi = min(whole, lo + SPAN)
                at = self.matches(text, lo, hi)
            here = at[pos - lo]
            if k is None:
                k = len(here) - 1
            while k >= -1:
                i = here[k] if k >= 0 else character(text[pos])
                if not dead or pos + size[i] not in failed:
                    ok = own.get(i)
                    if ok if ok is not None else fits(left, i):
                        break
                k -= 1
            if k >= -1:
                row.append(i)
                taken.append(k)
                pos += size[i]
                k = None
            else:
                # No piece fits here after this row: never come back, give the last piece back.
                failed.add(pos)
                dead = True
                if not row:
                    raise ValueError(f"no encoding for {text[:40]!r}")
                pos -= size[row.pop()]
                k = taken.pop() - 1
            left = row[-1] if row else None
            own = pairs.get(left)
            if own is None:
                own = pairs[left] = {}
        return row

    def ids(self, row: list[int]) -> bytes:
        n = len(self.pieces)
        if max(row) >= n:
            out: list[int] = []
            for i in row:
                if i < n:
                    out.append(i)
                elif self.fallback:
                    out += [self.byte[b] for b in self.text[i].encode()]
                else:
                    out.append(self.unk)
            row = out
        return struct.pack(f"<{len(row)}I", *row)

    def fresh(self, parts: list[bytes]):
        """``(ids, sizes)`` of distinct pieces of text."""
        return unpacked([self.ids(self.backtrack(p.decode("utf-8", "replace").replace(" ", MARK))) for p in parts])

    def cuts(self, offsets, data):
        """Places at which the texts fall into pieces of text that are encoded by themselves:
        between two characters that stand side by side in no piece of the vocabulary."""
        import numpy as np

        n = len(data)
        mark = np.zeros(n + 1, bool)
        mark[offsets] = mark[n] = True
        if n > 1:
            mark[1:n] |= ~self.joined[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)
        return np.flatnonzero(mark)

    def encode_flat(self, offsets, data):
        """``(token offsets, ids)`` of a slice of texts, begin and end ids included."""
        import numpy as np

        if self.dummy:  # a space before every text that isn't empty
            some = offsets[1:] > offsets[:-1]
            data = np.insert(data, offsets[:-1][some], np.uint8(0x20))
            offsets = offsets + sums(some)
        cuts = self.cuts(offsets, data)
        ids, sizes = ids_of_pieces(data, cuts, self.store)
        at = sums(sizes)[np.searchsorted(cuts, offsets)] if len(data) else np.zeros(len(offsets), np.int64)
        n = len(offsets) - 1
        ends = np.stack([at[:-1], at[1:]], axis=1).ravel()
        ids = np.insert(ids, ends, np.tile(np.array([self.bos, self.eos], "<u4"), n))
        return at + 2 * np.arange(n + 1), ids

    def decode_flat(self, offsets, ids):
        """``(byte offsets, bytes)`` of the texts of rows of ids. Control ids say nothing; the
        mark at the beginning of a row's first other piece is dropped. Ids beyond the
        vocabulary raise ``IndexError``."""
        import numpy as np

        sizes = self.said_size[ids]
        byte_at = sums(sizes)
        out = [gather(self.said, self.said_at[ids[lo:hi]], sizes[lo:hi])
               for lo, hi in windows(byte_at, WINDOW_BYTES)]
        data = np.concatenate([np.zeros(0, np.uint8), *out])
        where = byte_at[offsets]
        # The first id of each row that is no control id.
        real = np.flatnonzero(~self.control[ids])
        first = np.searchsorted(real, offsets[:-1])
        has = first < len(real)
        has[has] &= real[first[has]] < offsets[1:][has]
        lead = np.zeros(len(offsets) - 1, bool)
        lead[has] = self.marked[ids[real[first[has]]]]
        if self.dummy:
            data = np.delete(data, where[:-1][lead])
            where = where - sums(lead)
        return where, data


def one_each(error: UnicodeDecodeError) -> tuple[str, int]:
    """A replacement character for every byte that is no UTF-8."""
    return "�" * (error.end - error.start), error.end


codecs.register_error("one_each", one_each)


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str | None) -> PieceBpe:
    return worker_state(f"piece:{path}", lambda: PieceBpe(path or model_path()))


def _run(docs: DataFrame, id_col: str, text_col: str, path: str | None, schema: str) -> DataFrame:
    digest = schema == DIGEST

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        codecs.register_error("one_each", one_each)
        model = load(path)
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            for part in slices_by_bytes(batch, 1, WINDOW_BYTES):
                at, ids = model.encode_flat(*flat(part.column(1)))
                where, text = model.decode_flat(at, ids)
                raw, said = ids.astype("<u4").tobytes(), text.tobytes()
                n = len(part)
                said = [said[where[i]:where[i + 1]].decode("utf-8", "one_each") for i in range(n)]
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

    ``ids`` (little-endian unsigned 32-bit) begin and end with the model's begin and end
    ids; ``decoded`` is the text of the ids. A null text counts as empty (two ids, empty
    decoded text); a null ``doc_id`` stays null; repeated rows stay repeated; an empty
    table gives an empty result; other columns are ignored. A control piece's own string
    in a text is ordinary text. ``path`` must exist on every executor (default: the
    public 32k model).
    """
    return _run(docs, id_col, text_col, path, OUT)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   path: str | None = None) -> DataFrame:
    """:func:`encode` with sha256 digests in place of the ids and the decoded text,
    made where the ids are, so neither leaves the task."""
    return _run(docs, id_col, text_col, path, DIGEST)


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``doc_id, decoded`` of rows of packed ids. Null ids count as none; bytes that are no
    UTF-8 become one U+FFFD each; an id beyond the vocabulary fails the task; repeated rows
    stay, other columns are ignored."""
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        codecs.register_error("one_each", one_each)
        model = load(path)
        for batch in batches:
            for part in slices_by_bytes(batch, 1, WINDOW_BYTES):
                offsets, data = flat(part.column(1))
                where, text = model.decode_flat(offsets // 4, np.ascontiguousarray(data).view("<u4"))
                text = text.tobytes()
                said = [text[a:b].decode("utf-8", "one_each") for a, b in zip(where, where[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(said, pa.string())],
                                                 names=["doc_id", "decoded"])

    src = pick(rows, doc_id=id_col, ids=ids_col).selectExpr("cast(doc_id as long) doc_id", "ids")
    return src.mapInArrow(work, "doc_id long, decoded string")
