"""Fill-in-middle transformation by in-place block rotation (operator 13).

A text's tokens are scanned for the two cuts; the three sentinels are put into a
bytearray of the text, which then reads prefix, middle, suffix. The suffix is moved to
its place by exchanging two neighbouring blocks with three reversals, in place; the
inverse rotation and the removal of the sentinels give the text back byte for byte.

The scan runs over a slice of texts at once (numpy on the Arrow buffer): a token ends
before a blank that follows a non-blank, and at the end of a text. All is row-local, so
there is no shuffle, no broadcast, and a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import pick, slices_by_bytes
from .ragged import flat, sums

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINEL = "<[PSM]>"
MARK = 3  # bytes of a sentinel

OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def reverse(view, lo: int, hi: int) -> None:
    """Reverse ``view[lo:hi]`` in place; half of the block is held beside it."""
    half = (hi - lo) // 2
    left = view[lo:lo + half].copy()
    view[lo:lo + half] = view[hi - half:hi][::-1]
    view[hi - half:hi] = left[::-1]


def rotate(buf: bytearray, lo: int, mid: int, hi: int) -> None:
    """Exchange the neighbouring blocks ``[lo, mid)`` and ``[mid, hi)`` by three reversals."""
    import numpy as np

    view = np.frombuffer(buf, np.uint8)
    reverse(view, lo, mid)
    reverse(view, mid, hi)
    reverse(view, lo, hi)


def arrange(text: bytes, a: int, b: int, form: str) -> bytearray:
    """``text`` cut at bytes ``a <= b`` in the order of ``form`` ('psm' or 'spm')."""
    buf = bytearray(text)
    buf[b:b] = SUFFIX
    buf[a:a] = MIDDLE
    buf[0:0] = PREFIX
    tail = b + 2 * MARK
    rotate(buf, a + MARK if form == "psm" else 0, tail, len(buf))
    return buf


def rebuild(output: bytes, form: str | None) -> bytes:
    """The text from which :func:`arrange` made ``output``; other forms are the text itself."""
    if form not in ("psm", "spm"):
        return output
    buf = bytearray(output)
    if form == "spm":
        at = buf.index(PREFIX)
        middle = buf.index(MIDDLE, at) - at
        rotate(buf, 0, at, len(buf))
        tail = len(buf) - at
    else:
        middle = buf.index(SUFFIX)
        at = buf.index(MIDDLE, middle)
        rotate(buf, middle, at, len(buf))
        tail = middle + len(buf) - at
    del buf[tail:tail + MARK]
    del buf[middle:middle + MARK]
    del buf[:MARK]
    return bytes(buf)


def scan(offsets, data):
    """``(n, ends, first)``: tokens of each text, the end of every token in ``data``, and
    the place of each text's first end."""
    import numpy as np

    blank = np.zeros(256, bool)
    blank[[0x20, *range(0x09, 0x0E)]] = True
    is_blank = blank[data]
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:][offsets[1:] > offsets[:-1]]] = True
    ends = last[1:].copy()
    ends[:-1] |= ~is_blank[:-1] & is_blank[1:]
    ends = np.flatnonzero(ends) + 1
    first = np.searchsorted(ends, offsets[:-1], "right")
    return np.searchsorted(ends, offsets[1:], "right") - first, ends, first


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42,
              rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """One row per document: ``doc_id, n`` (tokens), ``form`` ('plain', 'psm' or 'spm'),
    ``prefix_chars, middle_chars`` (code points, null if plain) and ``output``.

    The cuts and the form follow from sha256 of ``seed:doc_id`` alone: ``rate`` per cent of
    the texts are arranged, ``spm_rate`` per cent of these with the suffix first. A null
    text counts as empty; empty texts and texts that hold a sentinel stay plain; a null id hashes as an empty one and stays null; repeated rows give
    repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            for part in slices_by_bytes(batch, 1):
                offsets, data = flat(part.column(1))
                n, ends, first = scan(offsets, data)
                h1, h2, h3, h4 = (part.column(i).to_numpy() for i in range(2, 6))
                marked = pc.fill_null(pc.match_substring_regex(part.column(1), SENTINEL), False)
                plain = (n == 0) | marked.to_numpy(zero_copy_only=False) | (h3 % 100 >= rate)
                spm = h4 % 100 < spm_rate
                lo, hi = np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0)
                stops = np.append(ends, 0)  # an empty text has no end to look up
                a, b = (np.where(k > 0, stops[np.maximum(first + k - 1, 0)], offsets[:-1]) for k in (lo, hi))
                chars = sums((data & 0xC0) != 0x80)
                raw, out = data.tobytes(), []
                for i in range(part.num_rows):
                    s, e = offsets[i], offsets[i + 1]
                    out.append(raw[s:e] if plain[i] else
                               bytes(arrange(raw[s:e], int(a[i] - s), int(b[i] - s), "spm" if spm[i] else "psm")))
                form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
                    pa.array(chars[a] - chars[offsets[:-1]], pa.int64(), mask=plain),
                    pa.array(chars[b] - chars[a], pa.int64(), mask=plain), pa.array(out, pa.string())], names=names)

    src = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    groups = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    return src.select("doc_id", "text", *groups).mapInArrow(work, OUT)


def restore(rows: DataFrame) -> DataFrame:
    """Add ``restored``, the text rebuilt from ``output`` and ``form`` alone. A null output
    counts as empty, an unknown or null form as plain; repeated rows stay, other columns are
    kept (a column named ``restored`` is replaced), an empty table stays empty."""
    kept = [c for c in rows.columns if c != "restored"]
    where = kept.index("output")
    form_at = kept.index("form")
    schema = StructType([f for f in rows.schema.fields if f.name != "restored"]).add("restored", "string")

    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in slices_by_bytes(batch, where):
                outputs = part.column(where).cast(pa.binary()).to_pylist()
                texts = [rebuild(o or b"", f) for o, f in zip(outputs, part.column(form_at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*kept, "restored"])

    plain = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    return plain.mapInArrow(work, schema)
