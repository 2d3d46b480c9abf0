"""Token ids in bit-plane files (operator 1).

A segment file holds the ids of consecutive documents in fixed-size blocks. Each
block is transposed into bit planes (or byte planes) and every plane is a
zstandard frame of its own; the chunk index at the end has each block's length,
plane count and the planes' places, so a block, or only its low planes, can be
read alone. Segments are written by Spark's own file writer (raw bytes, one
record a file), hence to any file system, with its commit protocol: a lost task
leaves no half file. They are read back through ``binaryFile``.

Layout of a segment: planes of all blocks, then the directory (a zstandard frame
of little-endian arrays: doc ids, null flags, token counts, block lengths, plane
counts, plane offsets), then ``<QIIQQ`` = directory place, its length, plane
kind, partition, number in the partition, then the magic bytes. The magic's
last byte is the line feed with which the writer ends a record.

Documents are dealt by ranges of their id, so files in partition order are in
ascending id order. One task holds one segment of ids, never a partition.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encode_flat, tokenizer_path
from .common import pick, scratch, slices_by_bytes, worker_state, written
from .ragged import WINDOW_BYTES, PieceStore, flat, gather, sums, unpacked

MAGIC = b"BITPLN1\n"
TAIL = "<QIIQQ"
BLOCK_IDS = 65_536
SEGMENT_IDS = 4 << 20
# Texts or chunks given to the library at a time (bounds its memory).
LIBRARY_BATCH = 4_096


class Encoder:
    """The tokenizers library behind a cache of pieces: a text is cut at sure word borders of
    the byte-level pre-tokenizer (:func:`bpe.word_cuts`), so the ids of the pieces in a
    row are the ids of the text. Distinct pieces are found in Arrow and their ids
    put in a row by numpy, so no Python object is made for an occurrence. The
    cut is only used for that pre-tokenizer; any other file gets whole texts."""

    def __init__(self, path: str):
        import json

        import numpy as np
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.cuts = (pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
                     and pre.get("use_regex", True) and not spec.get("normalizer"))
        self.added = [a["content"] for a in spec.get("added_tokens", [])]
        self.store = PieceStore(self.fresh)
        if self.cuts:  # bytes of each token: in the byte-level alphabet a character is a byte
            sizes = {i: len(t) for t, i in spec["model"]["vocab"].items()}
            sizes |= {a["id"]: len(a["content"].encode()) for a in spec.get("added_tokens", [])}
            self.size = np.zeros(max(sizes) + 1, np.int64)
            self.size[list(sizes)] = list(sizes.values())

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), LIBRARY_BATCH):
            out += [struct.pack(f"<{len(e.ids)}I", *e.ids)
                    for e in self.tok.encode_batch_fast(texts[i:i + LIBRARY_BATCH], add_special_tokens=False)]
        return out

    def fresh(self, parts: list[bytes]):
        """``(ids, sizes)`` of distinct pieces of text. Those that begin with one space and end
        with no blank go to the library as one text; the tokens' bytes tell where one
        piece's ids end and the next one's begin. The others are given one by one."""
        import numpy as np

        size = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        at = sums(size)
        row = np.flatnonzero(size > 1)
        first, second, last, near = (data[x] for x in (at[row], at[row] + 1, at[row + 1] - 1, at[row + 1] - 2))
        # Printing ASCII, or two-byte characters past the Latin-1 signs: never a blank.
        solid = (second > 0x20) & (second < 0x7F) | (second >= 0xC3) & (second < 0xE0)
        solid &= (last > 0x20) & (last < 0x7F) | (near >= 0xC3) & (near < 0xE0)
        row = row[(first == 0x20) & solid]
        known: dict[int, tuple] = {}  # first piece of a stretch of the row: its ids and their cuts
        lone = np.ones(len(parts), bool)
        for i in range(0, len(row), LIBRARY_BATCH):
            own = row[i:i + LIBRARY_BATCH]
            text = b"".join([parts[j] for j in own.tolist()]).decode("utf-8", "replace")
            if any(a in text for a in self.added):
                continue
            ids = np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends, reach = np.cumsum(size[own]), np.cumsum(self.size[ids])
            cut = np.searchsorted(reach, ends)
            if cut[-1] < len(reach) and (reach[cut] == ends).all():  # else not this vocabulary's way
                known[i] = ids, np.diff(cut, prepend=-1)
                lone[own] = False
        rest = np.flatnonzero(lone)
        ids, n = unpacked(self.whole([parts[j].decode("utf-8", "replace") for j in rest.tolist()]))
        order = np.concatenate([rest, *[row[i:i + LIBRARY_BATCH] for i in known]])
        ids = np.concatenate([ids, *[k[0] for k in known.values()]])
        n = np.concatenate([n, *[k[1] for k in known.values()]])
        back = np.argsort(order)
        return gather(ids, sums(n)[back], n[back]), n[back]

    def encode_flat(self, offsets, data):
        """``(token offsets, ids)`` of a slice of texts."""
        import numpy as np

        if self.cuts:
            return encode_flat(offsets, data, self.added, self.store)
        raw = data.tobytes()
        out = self.whole([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])])
        return sums([len(x) // 4 for x in out]), np.frombuffer(b"".join(out), "<u4")

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        import pyarrow as pa

        at, ids = self.encode_flat(*flat(pa.array(texts, pa.string())))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(at, at[1:])]


def planes_of(ids, kind: str) -> list[bytes]:
    """A block's planes, lowest first; as many as the largest id needs."""
    import numpy as np

    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(len(ids), 4)
    bits = max(1, int(ids.max()).bit_length())
    if kind == "byte":
        return [np.ascontiguousarray(raw[:, i]).tobytes() for i in range(-(-bits // 8))]
    low = np.ascontiguousarray(raw[:, :-(-bits // 8)])
    wide = np.unpackbits(low, axis=1, bitorder="little")[:, :bits]
    packed = np.packbits(np.ascontiguousarray(wide.T), axis=1, bitorder="little")
    return [p.tobytes() for p in packed]


def ids_of(planes: list[bytes], n: int, kind: str):
    """The inverse of :func:`planes_of`."""
    import numpy as np

    if kind == "byte":
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, np.uint8)
    else:
        size = -(-len(planes) // 8)
        wide = np.zeros((n, 8 * size), np.uint8)
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
        wide[:, :len(planes)] = np.unpackbits(rows, axis=1, bitorder="little", count=n).T
        raw = np.zeros((n, 4), np.uint8)
        raw[:, :size] = np.packbits(wide, axis=1, bitorder="little")
    return np.ascontiguousarray(raw).view("<u4").reshape(n)


def pack_segment(doc_ids: list[int | None], counts: list[int], ids, part: int, seq: int,
                 kind: str = "bit", block: int = BLOCK_IDS, level: int = 3) -> bytes:
    import numpy as np
    import zstandard

    press = zstandard.ZstdCompressor(level=level).compress
    body, lengths, n_planes, offsets, at = [], [], [], [0], 0
    for i in range(0, len(ids), block):
        part_ids = ids[i:i + block]
        planes = [press(p) for p in planes_of(part_ids, kind)]
        lengths.append(len(part_ids))
        n_planes.append(len(planes))
        for p in planes:
            at += len(p)
            offsets.append(at)
        body += planes
    index = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "<u1"),
             np.array(counts, "<i8"), np.array(lengths, "<i8"), np.array(n_planes, "<i8"), np.array(offsets, "<i8")]
    table = press(struct.pack("<2Q", len(doc_ids), len(lengths)) + b"".join(a.tobytes() for a in index))
    return b"".join([*body, table, struct.pack(TAIL, at, len(table), kind == "bit", part, seq), MAGIC[:-1]])


class Segment:
    """A reader of one segment's bytes."""

    def __init__(self, data: bytes):
        import numpy as np
        import zstandard

        if data[-len(MAGIC):] != MAGIC:
            raise ValueError("not a bit-plane segment")
        self.data, self.press = memoryview(data), zstandard.ZstdDecompressor()
        at, size, bit, self.part, self.seq = struct.unpack(
            TAIL, data[-len(MAGIC) - struct.calcsize(TAIL):-len(MAGIC)])
        self.kind = "bit" if bit else "byte"
        table = self.press.decompress(data[at:at + size])
        docs, blocks = struct.unpack("<2Q", table[:16])
        pos = 16

        def take(kind: str, n: int):
            nonlocal pos
            out = np.frombuffer(table, kind, n, pos)
            pos += out.nbytes
            return out

        self.doc_ids, self.null, self.counts = take("<i8", docs), take("<u1", docs), take("<i8", docs)
        self.lengths, self.n_planes = take("<i8", blocks), take("<i8", blocks)
        self.offsets = take("<i8", int(self.n_planes.sum()) + 1)
        self.first = np.concatenate([[0], np.cumsum(self.n_planes)])

    def block(self, i: int):
        """Ids of block ``i`` alone."""
        planes = [self.press.decompress(self.data[self.offsets[k]:self.offsets[k + 1]])
                  for k in range(self.first[i], self.first[i + 1])]
        return ids_of(planes, int(self.lengths[i]), self.kind)

    def ids(self):
        import numpy as np

        blocks = [self.block(i) for i in range(len(self.lengths))]
        return np.concatenate(blocks) if blocks else np.zeros(0, "<u4")


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str | None = None, end_id: int = 0, kind: str = "bit",
                 block: int = BLOCK_IDS, segment: int = SEGMENT_IDS) -> None:
    """Write the ids of all documents, in ascending id order, as bit-plane segments.

    ``end_id`` is added to every document. A null text counts as empty, a null id
    stands before all others, rows with equal ids go by their text, repeated rows
    stay, other columns are ignored; an empty table writes no segment. A document
    with more ids than a segment gets a larger segment of its own.
    """
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc = worker_state(f"hf:{tokenizer}", lambda: Encoder(tokenizer or tokenizer_path()))
        part, seq, end = TaskContext.get().partitionId(), 0, struct.pack("<I", end_id)
        keys: list = []
        counts: list[int] = []
        buf: list[bytes] = []
        held = 0

        def flush():
            nonlocal seq, held
            data = pack_segment(keys, counts, np.frombuffer(b"".join(buf), "<u4"), part, seq, kind, block)
            seq, held = seq + 1, 0
            keys.clear(), counts.clear(), buf.clear()
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["segment"])

        for batch in batches:
            for piece in slices_by_bytes(batch, 1, WINDOW_BYTES):
                at, flat_ids = enc.encode_flat(*flat(piece.column(1)))
                raw, at = flat_ids.astype("<u4").tobytes(), at.tolist()
                for i, k in enumerate(piece.column(0).to_pylist()):
                    ids = raw[4 * at[i]:4 * at[i + 1]]
                    n = len(ids) // 4 + 1
                    if held and held + n > segment:
                        yield flush()
                    keys.append(k)
                    counts.append(n)
                    buf.append(ids + end)
                    held += n
        if keys:
            yield flush()

    src = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (src.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(work, "segment binary").select(F.col("segment").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1).text(path))


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the segments: ``doc_id, part, seq, first`` (ids before it in its
    segment), ``n_tokens, ids_crc32`` and, on request, ``ids`` (little-endian 32 bits)."""
    schema = "doc_id long, part long, seq long, first long, n_tokens long, ids_crc32 long"
    schema += ", ids binary" if with_ids else ""

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                if not data:
                    continue
                seg = Segment(data)
                raw, at, rows = seg.ids().tobytes(), 0, []
                for d, null, n in zip(seg.doc_ids.tolist(), seg.null.tolist(), seg.counts.tolist()):
                    ids = raw[4 * at:4 * (at + n)]
                    rows.append((None if null else d, seg.part, seg.seq, at, n, zlib.crc32(ids), ids))
                    at += n
                cols = [pa.array(c, pa.int64()) for c in list(zip(*rows))[:6]]
                if with_ids:
                    cols.append(pa.array([r[6] for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    return (spark.read.format("binaryFile").load(path).where("length > 0").select("content")
            .mapInArrow(work, schema))


def with_start(docs: DataFrame) -> DataFrame:
    """Add ``start``: ids of all documents before a document, over all segments. The
    running sums go over segments within a partition and over partitions, never
    over documents."""
    segs = docs.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    parts = segs.groupBy("part").agg(F.sum("n").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = segs.select("part", "seq", (F.sum("n").over(
        Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("lead"))
    place = inside.join(before, "part").select("part", "seq", (F.col("base") + F.col("lead")).alias("base"))
    return docs.join(place, ["part", "seq"]).withColumn("start", F.col("base") + F.col("first"))


def token_files(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write ``docs`` and read the files back: ``doc_id, start, n_tokens, ids_crc32``.
    Only the small per-document table is kept between the two passes."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    write_tokens(docs, path, **kw)
    rows = written(read_tokens(spark, path, with_ids=False), "token-rows")
    return with_start(rows).select("doc_id", "start", "n_tokens", "ids_crc32")
