"""Benchmark decontamination by a prefix-filtered set join (operator 10).

Every benchmark item is cut into windows of ``size`` words (shorter items are one
window). A window is the set to be contained whole in a document window of its own
size, so its necessary prefix, with words ordered by rarity over all documents, is
its one rarest word: a document position is a candidate only if it holds that
word. The word's offset in the window gives the only possible start; length and
positional bounds drop starts outside the document before the words are compared
one by one.

Work per document is row-local. The benchmark is walked in blocks of bounded size,
each sent to the tasks once: a stated query set against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, slices_by_bytes, stored, written

WINDOW = 10
# Words of benchmark windows that are sent to the tasks in one block (about 20 MB).
BLOCK_WORDS = 400_000


def _word_bytes() -> bytes:
    """Byte map: A-Z to lower case, other ASCII but letters and digits to blanks."""
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else 32 for b in range(256))


WORD_BYTES = _word_bytes()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``item_id, win`` (array of words, one row per distinct window and item)."""
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices_by_bytes(batch, 1, 1 << 18):
                ids, wins = [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = words(t)
                    if w:
                        own = {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))}
                        wins += own
                        ids += [k] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(wins, pa.list_(pa.binary()))], names=["item_id", "win"])

    src = pick(items, item_id=id_col, text=text_col).selectExpr("cast(item_id as long) item_id", "text")
    return src.mapInArrow(work, "item_id long, win array<binary>").distinct()


def rarity(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """Occurrences over all documents of the words of one benchmark block."""
    def work(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for part in slices_by_bytes(batch, 1):
                for t in part.column(1).to_pylist():
                    total.update(filter(known, words(t)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["w", "n"])

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    known = _Known(sent)
    rows = docs.mapInArrow(work, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()
    sent.unpersist()
    return {bytes(r.w): r.n for r in rows}


class _Known:
    """Membership in a broadcast set, as a filter function."""

    def __init__(self, sent):
        self.sent = sent

    def __call__(self, w: bytes) -> bool:
        return w in self.sent.value


def index_of(wins: list[tuple], counts: dict[bytes, int]) -> dict[bytes, list[tuple]]:
    """Prefix index: rarest word -> ``(offset, window, item ids)``. Ties go to the first word
    in byte order, then to its first offset."""
    items: dict[tuple, list] = {}
    for item, win in wins:
        items.setdefault(win, []).append(item)
    index: dict[bytes, list[tuple]] = {}
    for win, own in items.items():
        rare = min(win, key=lambda w: (counts.get(w, 0), w))
        index.setdefault(rare, []).append((win.index(rare), win, own))
    return index


def hits(doc_words: list[bytes], index: dict[bytes, list[tuple]]) -> list[tuple[int, int, list]]:
    """Occurrences ``(start, length, items)`` of indexed windows in a document."""
    out, n = [], len(doc_words)
    for i, entries in [(i, index[w]) for i, w in enumerate(doc_words) if w in index]:
        for offset, win, items in entries:
            start = i - offset
            if start >= 0 and start + len(win) <= n and tuple(doc_words[start:start + len(win)]) == win:
                out.append((start, len(win), items))
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ``(start, end)`` runs, touching ones joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def blocks_of(wins: DataFrame, block_words: int, size: int):
    """Windows by blocks of bounded size; every item's windows may lie in several."""
    total = wins.count()
    n = max(1, -(-total * size // block_words))
    part = wins.withColumn("block", F.pmod(F.xxhash64("win"), F.lit(n)))
    for b in range(n if total else 0):
        yield [(r.item_id, tuple(bytes(w) for w in r.win)) for r in part.where(F.col("block") == b).collect()]


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW,
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, spans, items``.

    ``spans`` are the hit word runs ``{start, end}`` (end exclusive, merged), ``items``
    the distinct ids of items with a window in the document. Nulls, empty texts and
    texts without a word have no words; an item without words has no window; an
    item with a null id counts under null and is named by no list. Documents keep
    repeated rows and null ids; an empty table on either side gives no hits. Other
    columns are ignored.
    """
    state = "doc_id long, text string, n_words long, spans array<struct<start:int,end:int>>, items array<long>"
    src = pick(docs, doc_id=id_col, text=text_col).selectExpr(
        "cast(doc_id as long) doc_id", "text", "0L n_words", "cast(array() as array<struct<start:int,end:int>>) spans",
        "cast(array() as array<long>) items")
    wins = stored(windows_of(items, item_id_col, item_text_col, size))
    sc = docs.sparkSession.sparkContext

    def scan(sent, last: bool):
        def work(batches: Iterator) -> Iterator:
            import pyarrow as pa

            types = [pa.int64(), pa.string(), pa.int64(),
                     pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.int64())]
            index = sent.value
            for batch in batches:
                for part in slices_by_bytes(batch, 1):
                    rows = []
                    for k, t, _, spans, own in zip(*(part.column(i).to_pylist() for i in range(5))):
                        w = words(t)
                        found = hits(w, index)
                        runs = merged([(x["start"], x["end"]) for x in spans] + [(s, s + m) for s, m, _ in found])
                        own = {*own, *(x for *_, more in found for x in more if x is not None)}
                        rows.append((k, None if last else t, len(w), [{"start": a, "end": b} for a, b in runs],
                                     sorted(own)))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                     names=["doc_id", "text", "n_words", "spans", "items"])
        return work

    # Each block adds to what the blocks before it found; between blocks the rows are stored.
    blocks = blocks_of(wins, block_words, size)
    block, rows = next(blocks, []), src
    while block is not None:
        after = next(blocks, None)
        counts = rarity(src, {w for _, win in block for w in win}) if block else {}
        rows = rows.mapInArrow(scan(sc.broadcast(index_of(block, counts)), after is None), state)
        rows = rows if after is None else written(rows, "decontam")
        block = after
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without a hit. The decision is made on the text itself, so rows of
    one id with different texts are told apart; null texts stay."""
    hit = contamination(docs.withColumn("__h", F.xxhash64(F.col(f"`{text_col}`"))), items, "__h", text_col,
                        item_id_col, item_text_col, size).where("n_hit > 0")
    bad = stored(hit.select(F.col("doc_id").alias("__h")).distinct())
    return docs.join(bad, F.xxhash64(F.col(f"`{text_col}`")) == bad["__h"], "left_anti")
