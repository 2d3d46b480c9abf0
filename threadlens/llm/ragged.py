"""Arrow text columns as flat numpy buffers: cutting texts and gathering rows of uneven length.

The per-occurrence work of the token operators (cutting a text, looking a piece's ids up,
putting them in a row) runs on these buffers, so Python objects are made for distinct
pieces only.
"""

from __future__ import annotations


def flat(column):
    """``(offsets, data)`` of an Arrow string or binary column: int64 offsets from 0 and the
    bytes of all rows in a row. A null is a row of no bytes."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def pieces(data, cuts):
    """The byte strings between neighbouring ``cuts`` as an Arrow array (no copy of the bytes)."""
    import numpy as np
    import pyarrow as pa

    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(cuts) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(cuts, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def sums(counts):
    """Running totals with a leading 0: offsets of rows with ``counts`` entries."""
    import numpy as np

    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def gather(values, starts, sizes):
    """``values[starts[i] : starts[i] + sizes[i]]`` for all i in a row."""
    import numpy as np

    ends = sums(sizes)
    return values[np.arange(ends[-1]) + np.repeat(starts - ends[:-1], sizes)]


def binary_array(offsets, data, kind):
    """An Arrow array of type ``kind`` (binary or string) over flat bytes."""
    import numpy as np
    import pyarrow as pa

    big = pa.large_string() if kind == pa.string() else pa.large_binary()
    out = pa.Array.from_buffers(big, len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)),
        pa.py_buffer(np.ascontiguousarray(data, dtype=np.uint8))])
    return out.cast(kind)


# Bytes of text whose pieces are numpy arrays at a time: bounds memory within one very long text.
WINDOW_BYTES = 4 << 20


def windows(cuts, limit: int = WINDOW_BYTES):
    """Ranges ``lo, hi`` of pieces with about ``limit`` bytes at most, one piece at least."""
    import numpy as np

    lo, n = 0, len(cuts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def ids_of_pieces(data, cuts, store: PieceStore, limit: int = WINDOW_BYTES):
    """``(ids, sizes)``: the ids of all pieces in a row and how many each piece has. The
    store is asked once for each distinct piece of a window."""
    import numpy as np

    ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for lo, hi in windows(cuts, limit):
        coded = pieces(data[cuts[lo]:cuts[hi]], cuts[lo:hi + 1] - cuts[lo]).dictionary_encode()
        held, starts, n = store.rows(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        sizes.append(n[codes])
        ids.append(gather(held, starts[codes], sizes[-1]))
    return np.concatenate(ids), np.concatenate(sizes)


def unpacked(rows: list[bytes]):
    """``(ids, sizes)`` of rows of packed little-endian 32-bit ids."""
    import numpy as np

    return np.frombuffer(b"".join(rows), "<u4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4


def grown(array, used: int, more):
    """``array`` with ``more`` put after its first ``used`` entries; its room doubles."""
    import numpy as np

    need = used + len(more)
    if need > len(array):
        wide = np.empty(max(need, 2 * len(array)), array.dtype)
        wide[:used] = array[:used]
        array = wide
    array[used:need] = more
    return array


class PieceStore:
    """Ids of pieces of text seen by a worker, in one flat array. ``fresh`` encodes a list of
    distinct new pieces (bytes) and gives ``(ids, sizes)``. Past ``limit`` bytes (pieces, ids
    and what Python adds to each) all is dropped and built anew: memory only."""

    ENTRY = 200

    def __init__(self, fresh, limit: int = 64 << 20):
        self.fresh, self.limit = fresh, limit
        self.reset()

    def reset(self) -> None:
        import numpy as np

        self.place: dict[bytes, int] = {}
        self.ids, self.used = np.zeros(1 << 16, "<u4"), 0
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i]: where the ids of piece i - 1 end
        self.held = 0

    def rows(self, parts: list[bytes]):
        """``(ids, starts, sizes)``: where in ``ids`` those of each piece stand."""
        import numpy as np

        if self.held > self.limit:
            self.reset()
        get = self.place.get
        at = np.array([get(p, -1) for p in parts], np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            own = [parts[i] for i in new.tolist()]
            ids, sizes = self.fresh(own)
            n = len(self.place)
            self.ids = grown(self.ids, self.used, ids)
            self.ends = grown(self.ends, n + 1, self.used + np.cumsum(sizes))
            self.used += len(ids)
            at[new] = n + np.arange(len(own))
            self.place.update(zip(own, range(n, n + len(own))))
            self.held += sum(map(len, own)) + 4 * len(ids) + self.ENTRY * len(own)
        return self.ids, self.ends[at], self.ends[at + 1] - self.ends[at]
