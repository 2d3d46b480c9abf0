"""Exact-substring dedup by interval refinement on a sparse suffix set (operator 6).

A byte goes when a string of ``length`` bytes that covers it also starts somewhere
else. Every start of such a string belongs to one suffix of a sparse set: the
minimizer of the string's first bytes, which depends on those bytes alone, so equal
strings get equal suffixes wherever they stand. Each shard (task) lists its sparse
suffixes with two names: the *core*, bytes that all strings of the suffix share, and
the *full* name, the symbol run before the suffix together with all that follows.

Shards are merged round by round. A round interleaves the shards' names in one
aggregate: an interval (equal cores) of one suffix is unique and leaves; in an
interval of which two or more have equal full names, those are repeats with all
their starts; what is left differs within the interval and is refined: its starts are
cut into shorter runs, whose cores are longer, and merged again, until runs are
single starts. Common prefixes of all intervals are known from the run lengths, and
no round sorts or moves suffixes that an earlier one settled. Members of an interval
are never gathered, so an interval may hold any share of all suffixes.

See the README for how this stands to a literal merge of byte-level transforms.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, release, slices_by_bytes, written

LENGTH = 400
# Starts of one run in the rounds after the first.
STEPS = (8, 1)
# Bytes of a text whose minimizers are worked out at once.
CHUNK = 1 << 22

ROWS = "c long, f1 long, f2 long, r1 long, r2 long, lo int, hi int, at int, w int"


def geometry(length: int) -> tuple[int, int]:
    """Starts looked at for a minimizer (a power of two) and bytes it is chosen by."""
    gram = 16 if length >= 64 else 4
    span = 1
    while 2 * span + gram - 1 <= 0.75 * length:
        span *= 2
    return span, gram


def minimizers(data: bytes, length: int, chunk: int = CHUNK):
    """Runs ``(lo, hi, at)``: starts ``lo`` to ``hi`` of ``length``-byte strings have their minimizer
    at ``at`` (the leftmost smallest gram hash among the first starts of the string)."""
    import numpy as np

    span, gram = geometry(length)
    starts = len(data) - length + 1
    lows, ats = [], []
    for base in range(0, starts, chunk):
        n = min(chunk, starts - base)
        raw = np.frombuffer(data, np.uint8, n + span + gram - 2, base)
        h = raw.astype(np.uint64) + np.uint64(1)
        step = 1
        while step < gram:
            h = h[:-step] * np.uint64(pow(0x9E3779B97F4A7C15, step, 1 << 64)) + h[step:]
            step *= 2
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        # High half: the gram's hash; low half: its place, so the leftmost of equals wins.
        x = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        step = 1
        while step < span:
            x = np.minimum(x[:-step], x[step:])
            step *= 2
        at = (x[:n] & np.uint64(0xFFFFFFFF)).astype(np.int64) + base
        new = np.append(0, np.flatnonzero(at[1:] != at[:-1]) + 1)
        lows.append(new + base)
        ats.append(at[new])
    if not lows:
        return np.zeros((0, 3), np.int64)
    lo, at = np.concatenate(lows), np.concatenate(ats)
    keep = np.append(True, at[1:] != at[:-1])  # a run may go over the border of two chunks
    lo, at = lo[keep], at[keep]
    return np.stack([lo, np.append(lo[1:] - 1, starts - 1), at], 1)


def text_key(text: bytes) -> tuple[int, int]:
    """128 bits that stand for a text, as two signed longs."""
    d = hashlib.md5(text, usedforsecurity=False).digest()
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def key_columns(text):
    """:func:`text_key` as column expressions."""
    d = F.md5(text.cast("binary"))
    return [F.conv(F.substring(d, i, 16), 16, -10).cast("long") for i in (1, 17)]


def cells(lo: int, hi: int, at: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """Cut starts ``lo`` to ``hi`` on a grid that is fixed to the suffix: the cut run, and the
    grid cell's first and last start."""
    k = (at - lo) // step
    while True:
        first, last = at - k * step - (step - 1), at - k * step
        if first > hi:
            return
        yield max(lo, first), min(hi, last), first, last
        k -= 1


def names(data: bytes, lo: int, hi: int, first: int, last: int, at: int, length: int) -> tuple[int, int, int]:
    """Core (64 bits, only ever used to rule out) and full name (128 bits) of a run of starts."""
    import xxhash

    core = xxhash.xxh3_64_intdigest(data[last:first + length], (at - last) & 0xFFFF)
    full = xxhash.xxh3_128_intdigest(data[lo:hi + length], (at - lo) << 32 | (hi - lo))
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    return sign(core), sign(full >> 64), sign(full & (1 << 64) - 1)


def _batch(rows: list[tuple]):
    import pyarrow as pa

    types = [pa.int64()] * 5 + [pa.int32()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=[c.split()[0] for c in ROWS.split(", ")])


def suffixes(texts: DataFrame, length: int) -> DataFrame:
    """The first round's rows: one for each sparse suffix of each text."""
    span, _ = geometry(length)

    def work(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in slices_by_bytes(batch, 0):
                rows = []
                for t in part.column(0).to_pylist():
                    data = (t or "").encode("utf-8", "surrogatepass")
                    if len(data) < length:
                        continue
                    r = text_key(data)
                    for lo, hi, at in minimizers(data, length).tolist():
                        c, f1, f2 = names(data, lo, hi, at - span + 1, at, at, length)
                        rows.append((c, f1, f2, *r, lo, hi, at, 1))
                        if len(rows) >= 20_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return texts.select("text").mapInArrow(work, ROWS)


def shorter(texts: DataFrame, length: int, step: int) -> DataFrame:
    """Rows of a later round: the open runs of ``texts`` (``text, r1, r2, open``) cut by ``step``."""
    def work(batches: Iterator) -> Iterator:
        for batch in batches:
            for part in slices_by_bytes(batch, 0):
                rows = []
                for t, r1, r2, runs in zip(*(part.column(i).to_pylist() for i in range(4))):
                    data = t.encode("utf-8", "surrogatepass")
                    for run in runs:
                        for lo, hi, first, last in cells(run["lo"], run["hi"], run["at"], step):
                            rows.append((*names(data, lo, hi, first, last, run["at"], length),
                                         r1, r2, lo, hi, run["at"], run["w"]))
                        if len(rows) >= 20_000:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return texts.select("text", "r1", "r2", "open").mapInArrow(work, ROWS)


def interleave(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One merge round: ``(repeats, open)`` with columns ``r1, r2, lo, hi, at, w``.

    ``repeats``: runs whose full name stands there twice or more. ``open``: one run for
    each full name of an interval with several full names; ``w`` is 2 for a repeat
    (it only vouches for others), else 1. ``rows`` is evaluated twice.
    """
    spark = rows.sparkSession
    cores = written(rows.groupBy("c").agg(F.sum("w").alias("n")).where("n > 1").select("c"), "sfx-cores")
    kept = written(rows.join(cores, "c"), "sfx-kept")
    release(spark)
    run = F.struct("r1", "r2", "lo", "hi", "at")
    full = written(kept.groupBy("c", "f1", "f2").agg(F.sum("w").alias("n"), F.min(run).alias("one")), "sfx-full")
    mixed = written(full.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c"), "sfx-mixed")
    open_ = written(full.join(mixed, "c").select("one.*", F.least("n", F.lit(2)).cast("int").alias("w")), "sfx-open")
    again = full.where("n > 1").select("c", "f1", "f2")
    repeats = written(kept.where("w = 1").join(again, ["c", "f1", "f2"]).select("r1", "r2", "lo", "hi").distinct(),
                      "sfx-repeats")
    release(spark)
    return repeats, open_


def by_text(runs: DataFrame, name: str, *fields: str) -> DataFrame:
    """Runs of a text as one array (a text has no more of them than starts)."""
    return runs.groupBy("r1", "r2").agg(F.collect_list(F.struct(*fields)).alias(name))


def cover(runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs covered by the strings that start at ``lo`` to ``hi``."""
    out: list[list[int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + length)
        else:
            out.append([lo, hi + length])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row; on request also
    ``kept`` (the bytes left, binary).

    Texts are UTF-8 bytes; a null text counts as empty; texts under ``length`` bytes lose
    nothing. Strings never cross rows; repeated rows are copies of each other and go
    whole if long enough. Null ids keep their rows; an empty table gives no rows;
    other columns are ignored.
    """
    src = pick(docs, doc_id=id_col, text=text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    long_ = src.where(F.octet_length("text") >= length)
    repeats, open_ = interleave(suffixes(long_, length))
    k1, k2 = key_columns(F.col("text"))
    keyed = src.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes"),
                       F.sha2(F.col("text").cast("binary"), 256).alias("sha"), k1.alias("r1"), k2.alias("r2"))
    marks = by_text(repeats.withColumn("at", F.lit(0)).withColumn("w", F.lit(0)).unionByName(open_),
                    "runs", "lo", "hi", "at", "w")
    held = keyed.join(written(marks, "sfx-marks"), ["r1", "r2"], "left")
    # Texts without a mark are done; the others are kept for the rounds that follow.
    held = written(held.withColumn("text", F.when(F.col("runs").isNotNull(), F.col("text"))), "sfx-texts")
    release(docs.sparkSession)
    found = [repeats]
    texts = held.where("runs is not null").select(
        "text", "r1", "r2", F.filter("runs", lambda x: x["w"] > 0).alias("open")).where("size(open) > 0")
    for i, step in enumerate(STEPS):
        repeats, open_ = interleave(shorter(texts, length, step))
        found.append(repeats)
        if i + 1 < len(STEPS):
            texts = texts.select("text", "r1", "r2").join(
                written(by_text(open_, "open", "lo", "hi", "at", "w"), "sfx-next"), ["r1", "r2"])
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    dup = written(by_text(every, "dup", "lo", "hi"), "sfx-dup")

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    out += ", kept binary" if with_text else ""

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        types = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text
        for batch in batches:
            for part in slices_by_bytes(batch, 1):
                rows = []
                for k, t, runs in zip(*(part.column(i).to_pylist() for i in range(3))):
                    data = t.encode("utf-8", "surrogatepass")
                    spans, at, left = cover([(x["lo"], x["hi"]) for x in runs], length), 0, []
                    for a, b in spans:
                        left.append(data[at:a])
                        at = b
                    left = b"".join([*left, data[at:]])
                    rows.append((k, len(data), len(data) - len(left), len(spans),
                                 hashlib.sha256(left).hexdigest(), left))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=[c.split()[0] for c in out.split(", ")])

    marked = held.where("runs is not null").select("doc_id", "text", "r1", "r2", "n_bytes", "sha")
    both = marked.join(dup, ["r1", "r2"], "left")
    done = both.where("dup is not null").select("doc_id", "text", "dup").mapInArrow(cut, out)
    whole = ["doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
             F.col("sha").alias("kept_sha256")]
    if with_text:
        clean = src.join(dup, [k1 == dup.r1, k2 == dup.r2], "left_anti").select(
            "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *whole[2:4],
            F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
        return done.unionByName(clean)
    return (done.unionByName(both.where("dup is null").select(*whole))
                .unionByName(held.where("runs is null").select(*whole)))
