"""Words of text batches in numpy, for jobs whose time goes into single words."""

from __future__ import annotations

# Bytes of text that a task cuts into words at a time (one text at least).
HELD_BYTES = 4 << 20


def slices(batch, column: int, most: int = HELD_BYTES):
    """A record batch cut into parts whose strings in ``column`` have about ``most`` bytes."""
    import numpy as np
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size, dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def letter_runs(texts):
    """``words, row, data, start``: the ``[a-z]+`` runs of a string array (null: empty) in order, each
    one's row, the texts' bytes and each run's first byte in them. No run crosses rows."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pc.fill_null(texts.cast(pa.string()), "")
    none = np.zeros(0, np.int64)
    if not len(texts) or texts.buffers()[2] is None:
        return pa.array([], pa.string()), none, np.zeros(0, np.uint8), none
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0]:at[-1]]
    at -= at[0]
    letter = (data >= 97) & (data <= 122)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = at[:-1][at[:-1] < len(data)]
    begins[first] = letter[first]
    start = np.flatnonzero(begins)
    chars = data[letter]
    ends = np.append((np.cumsum(letter, dtype=np.int32) - 1)[start], len(chars)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(chars)))
    return words, np.searchsorted(at, start, "right") - 1, data, start


def counted_words(df, text_col: str):
    """``df`` without ``text_col`` and with ``term, n``: a row for each word that the row's lower-cased
    text has, and how often."""
    from pyspark.sql import functions as F

    names = [c for c in df.columns if c != text_col]
    rows = df.select(*names, F.lower(F.coalesce(text_col, F.lit(""))).alias(text_col))
    cut, runs = slices, letter_runs

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in cut(batch, len(names)):
                words, row, _, _ = runs(part.column(len(names)))
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                size = len(coded.dictionary)
                key, n = np.unique(row * size + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                own = pa.array(key // size)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i).take(own) for i in range(len(names))], coded.dictionary.take(pa.array(key % size)),
                     pa.array(n.astype(np.int64))], names=[*names, "term", "n"])

    schema = df.select(*names, F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).schema
    return rows.mapInArrow(work, schema)
