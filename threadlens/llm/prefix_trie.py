"""Conversation prefix trie from padded turn-id matrices (operator 12).

A conversation is a row of turn ids (128-bit digests of role and text) of its turns in
order. Rows are dealt by ranges of (turn ids, conversation id), so the conversations
under a node are neighbours and a group of equal conversations is cut like any other. A
shard is a run of sorted rows of bounded size, held as one matrix of small ids, padded
with 0: a lexsort puts the rows in order, the change masks of neighbouring rows,
OR-accumulated over the columns, mark where the node of each depth begins, and reduceat
over these starts gives every depth's figures, the deepest first.

A node that touches its shard's first or last row may go on in the next shard: it is
*open*. Shards give open nodes as partial rows, which one aggregate by path recombines;
what lies above them (leaves and saved tokens of subtrees that cross shards) comes from a
running sum over the open nodes in trie order, taken within partitions and then over the
partitions' totals. All other nodes are finished inside their shard; those whose parent
is open look its id up by (shard, parent), so no popular node gathers its children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, written
from .ragged import flat, sums

# Cells and rows of a shard's matrix; one longer conversation makes a shard of its own.
CELLS = 1 << 21
ROWS = 1 << 16
# Bytes of a piece of the id list of an open node (a list is hashed piece by piece).
PIECE = 4_096
ID = 16  # bytes of a turn id

EMPTY = hashlib.sha256(b"").hexdigest()
CLOSED, OPEN, LIST = 0, 1, 2
SHARD = ("kind int, part int, seq int, depth long, key binary, parent_key binary, conv_id long, "
         "parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string, bytes long, first long, last long, num long, ids string")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
              text_col: str = "text", group: int = 1) -> DataFrame:
    """``conv_id, base, turns``: the turns of each conversation in order, each a digest of role
    and text with the text's UTF-8 bytes; ``base`` is ``conv_id - conv_id % group``, and
    conversations of one base come in one task.

    Turns go by ``turn``, null first, those of equal number by role, then by digest; null
    role or text counts as empty; repeated rows are turns of their own; rows without a
    conversation id take no part; other columns are ignored; an empty table gives no row.
    Texts stay behind: a turn travels as 24 bytes and its role.
    """
    src = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = src.where("conv_id is not null").select(
        conv.alias("conv_id"), (conv - conv % F.lit(group)).alias("base"), "turn", role.alias("role"),
        F.unhex(F.substring(digest, 1, 2 * ID)).alias("id"), F.octet_length(text).cast("long").alias("bytes"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "id", "bytes")))
    return (rows.repartition("base").groupBy("base", "conv_id").agg(turns.alias("turns"))
            .select("conv_id", "base", F.transform("turns", lambda t: F.struct(t["id"].alias("id"),
                                                                               t["bytes"].alias("bytes"))).alias("turns")))


def crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def splice(rows: DataFrame, modulus: int = 9) -> DataFrame:
    """Rebuild conversations of :func:`sequences`: the first ``h`` turns of the base
    conversation (all if it has fewer, none if there is no such conversation), then the
    conversation's own turns after its first ``h``; ``h`` is crc32 of the id, modulo
    ``modulus``. At most ``modulus - 1`` turns of a base are handed on."""
    h = (crc(F.col("conv_id")) % F.lit(modulus)).cast("int")
    head = F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, modulus - 1))
    found = F.max(head).over(Window.partitionBy("base"))
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return rows.withColumn("head", found).withColumn("own", own).select(
        "conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("own", 1, 0)), "own").alias("turns"))


class Rows:
    """Sorted rows of a task, given out as shards of bounded size."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.conv: list[int] = []
        self.path: list[bytes] = []
        self.sizes: list = []
        self.deep = 0

    def full(self, turns: int) -> bool:
        n = len(self.conv)
        return n > 0 and (n >= ROWS or (n + 1) * max(self.deep, turns) > CELLS)

    def add(self, conv: int, path: bytes, sizes) -> None:
        self.conv.append(conv)
        self.path.append(path)
        self.sizes.append(sizes)
        self.deep = max(self.deep, len(path) // ID)


def turn_ids(raw: bytes):
    """Small ids (from 1) of turn digests, in the order of the digests."""
    import numpy as np

    words = np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)
    order = np.lexsort((words[:, 1], words[:, 0]))
    by = words[order]
    new = np.ones(len(by), bool)
    new[1:] = (by[1:] != by[:-1]).any(axis=1)
    out = np.zeros(len(by), np.int32)
    out[order] = np.cumsum(new)
    return out


def chain(path: bytes) -> list[bytes]:
    """Keys of the nodes on a path, the root's first."""
    out, h = [b""], hashlib.sha256()
    for i in range(0, len(path), ID):
        h.update(path[i:i + ID])
        out.append(h.digest()[:ID])
    return out


def shard_nodes(rows: Rows, part: int, seq: int) -> Iterator[list]:
    """Rows of :data:`SHARD` (as columns, a depth at a time) of one shard."""
    import numpy as np

    conv = np.array(rows.conv, np.int64)
    n = len(conv)
    length = np.array([len(p) // ID for p in rows.path], np.int64)
    deep = int(length.max())
    matrix = np.zeros((n, deep), np.int32)
    matrix[np.arange(deep) < length[:, None]] = turn_ids(b"".join(rows.path))
    order = np.lexsort((conv, *[matrix[:, d] for d in range(deep - 1, -1, -1)]))
    conv, length, matrix = conv[order], length[order], matrix[order]
    sizes = np.concatenate([np.asarray(s, np.int64) for s in rows.sizes]) if length.any() else np.zeros(0, np.int64)
    size_at = sums([len(s) for s in rows.sizes])[:-1][order]
    # begins[i, d]: row i differs from the row before it in one of its first d + 1 turns.
    begins = np.ones((n, deep), bool)
    np.logical_or.accumulate(matrix[1:] != matrix[:-1], axis=1, out=begins[1:])
    del matrix
    keys = chain(rows.path[order[0]]), chain(rows.path[order[-1]])

    def places(d: int):
        """Starts of the runs of rows with equal first ``d`` turns, and which are nodes."""
        at = np.flatnonzero(begins[:, d - 1]) if d else np.zeros(1, np.int64)
        return at, length[at] >= d

    leaves, saved, kids = (np.zeros(n, np.int64) for _ in range(3))
    at, node = places(deep)
    for d in range(deep, -1, -1):
        stop = np.append(at[1:], n)
        total = lambda x: np.add.reduceat(x, at)[node]  # noqa: E731, B023
        start, end = at[node], stop[node]
        is_open = (start == 0) | (end == n)
        members = end - start
        small = np.minimum.reduceat(conv, at)[node]
        ending = total((length == d).astype(np.int64))
        last_bytes = sizes[size_at[start] + d - 1] if d else np.zeros(1, np.int64)
        n_kids, n_leaves, n_saved = total(kids), total(leaves), total(saved)
        # Open nodes only hand on what lies below them; their own share follows later.
        n_leaves = np.where(is_open | (n_kids > 0), n_leaves, 1)
        n_saved = np.where(is_open, n_saved, n_saved + (members - 1) * last_bytes)
        for x, value in ((leaves, n_leaves), (saved, n_saved), (kids, (~is_open).astype(np.int64))):
            x[:] = 0
            x[start] = value

        above = places(d - 1) if d else (at, node)
        mine = np.searchsorted(above[0], start, "right") - 1
        up_start, up_end = above[0][mine], np.append(above[0][1:], n)[mine]
        up_open = (up_start == 0) | (up_end == n)
        up_conv = np.minimum.reduceat(conv, above[0])[mine]
        key = [keys[0 if s == 0 else 1][d] if o else None for s, o in zip(start.tolist(), is_open.tolist())]
        up_key = [keys[0 if s == 0 else 1][d - 1] if o and d else None for s, o in zip(up_start.tolist(), up_open.tolist())]
        hashes: list = [None if o else EMPTY for o in is_open.tolist()]
        lists: list[tuple[bytes, list]] = []
        for i in np.flatnonzero(ending):
            ids = conv[start[i]:start[i] + ending[i]].tolist()
            if is_open[i]:
                lists.append((key[i], ids))
            else:
                hashes[i] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        m = len(start)
        known = np.array([k is None for k in up_key]) & (d > 0)
        yield [np.where(is_open, OPEN, CLOSED), [part] * m, [seq] * m, [d] * m, key, up_key, small,
               [c if k else None for c, k in zip(up_conv.tolist(), known.tolist())], members, n_kids, n_leaves, n_saved,
               hashes, last_bytes, start, end - 1, [None] * m, [None] * m]
        pieces = [(k, num, text) for k, ids in lists for num, text in enumerate(list_pieces(ids))]
        if pieces:
            m, none = len(pieces), [None] * len(pieces)
            yield [[LIST] * m, [part] * m, [seq] * m, none, [p[0] for p in pieces], *[none] * 11,
                   [p[1] for p in pieces], [p[2] for p in pieces]]
        at, node = above


def list_pieces(ids: list[int]) -> Iterator[str]:
    held: list[str] = []
    size = 0
    for i in ids:
        held.append(str(i))
        size += len(held[-1]) + 1
        if size >= PIECE:
            yield ",".join(held)
            held, size = [], 0
    if held:
        yield ",".join(held)


def shards(rows: DataFrame) -> DataFrame:
    """Rows of :data:`SHARD` of all shards (see the module's text)."""
    names = [c.split()[0] for c in SHARD.split(", ")]

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, held = TaskContext.get().partitionId(), 0, Rows()
        types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
        kinds = [types[c.split()[1]] for c in SHARD.split(", ")]

        def flush() -> Iterator:
            nonlocal seq
            for cols in shard_nodes(held, part, seq):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            seq += 1
            held.clear()

        for batch in batches:
            conv = batch.column(0).to_pylist()
            at, raw = flat(batch.column(1))
            raw, at = raw.tobytes(), at.tolist()
            sizes = np.asarray(batch.column(2).flatten())
            for i, c in enumerate(conv):
                a, b = at[i], at[i + 1]
                if held.full((b - a) // ID):
                    yield from flush()
                held.add(c, raw[a:b], sizes[a // ID:b // ID])
        if held.conv:
            yield from flush()

    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["id"])), ""))
    src = rows.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (src.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
            .mapInArrow(work, SHARD))


def list_hashes(lists: DataFrame) -> DataFrame:
    """``key, ends_sha256``: one running hash a node over its pieces in order. A task holds a
    batch of pieces, never a node's whole list (a hash can only be taken in one stream)."""
    def work(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, h = None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()])],
                                              names=["key", "ends_sha256"])

        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h is None or k != key:
                    if h is not None:
                        yield done()
                    key, h = k, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
        if h is not None:
            yield done()

    return (lists.select("key", "part", "seq", "num", "ids").repartition("key")
            .sortWithinPartitions("key", "part", "seq", "num").select("key", "ids")
            .mapInArrow(work, "key binary, ends_sha256 string"))


def recombine(partial: DataFrame) -> DataFrame:
    """Open nodes from their shards' partial rows, with the figures of whole subtrees but
    without the hash: ``key, depth, parent_key, conv_id, n_convs, n_children, n_leaves,
    saved_tokens``."""
    merged = partial.groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("bytes").alias("bytes"),
        F.min(F.struct("part", "seq", "first")).alias("a"), F.max(F.struct("part", "seq", "last")).alias("z"))
    merged = written(merged, "open-nodes")
    kids = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(
        F.count(F.lit(1)).alias("open_kids"))
    # What each open node adds to its own subtree and to those above it.
    tree = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_kids", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    tree = written(tree.withColumn("own_leaf", leaf).withColumn("own_saved", (F.col("n_convs") - 1) * F.col("bytes")),
                   "open-tree")
    # In trie order a node opens before all below it and closes after them, so a subtree's sum is
    # the running sum at its close less the one before it opened.
    zero = F.lit(0).cast("long")
    opened = tree.select("key", F.col("a.part").alias("part"), F.col("a.seq").alias("seq"), F.col("a.first").alias("row"),
                         F.lit(0).alias("shut"), F.col("depth").alias("turn"), "own_leaf", "own_saved")
    closed = tree.select("key", F.col("z.part").alias("part"), F.col("z.seq").alias("seq"), F.col("z.last").alias("row"),
                         F.lit(1).alias("shut"), (-F.col("depth")).alias("turn"), zero.alias("own_leaf"),
                         zero.alias("own_saved"))
    order = Window.partitionBy("part").orderBy("seq", "row", "shut", "turn").rowsBetween(Window.unboundedPreceding, 0)
    events = opened.unionByName(closed)
    # One row per partition of the range deal: the window over them is as long as that.
    parts = events.groupBy("part").agg(F.sum("own_leaf").alias("l"), F.sum("own_saved").alias("s"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", *[F.coalesce(F.sum(c).over(over), zero).alias(c) for c in ("l", "s")])
    inside = events.select("key", "part", "shut", "own_leaf", "own_saved", F.sum("own_leaf").over(order).alias("lr"),
                           F.sum("own_saved").over(order).alias("sr"))
    sign = F.when(F.col("shut") == 1, 1).otherwise(-1)
    run = inside.join(parts, "part").groupBy("key").agg(
        F.sum(sign * (F.col("lr") + F.col("l") - F.col("own_leaf"))).alias("tl"),
        F.sum(sign * (F.col("sr") + F.col("s") - F.col("own_saved"))).alias("ts"))
    return tree.join(run, "key").select(
        "key", "depth", "parent_key", "conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("tl")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("ts")).alias("saved_tokens"))


def nodes(rows: DataFrame) -> DataFrame:
    """One row per trie node of ``conv_id, turns`` rows (conversation ids unique, as
    :func:`sequences` and :func:`splice` give them): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id`` (null for the root), ``n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256``.

    A conversation without turns is a member of the root. No conversation, no node (not
    even a root). Turns are told apart by 128 bits of sha256 of role and text. A
    conversation is one row of 24 bytes a turn, so its length is bounded by a task's memory.
    """
    got = written(shards(rows), "trie-shards")
    partial = got.where(F.col("kind") == OPEN)
    whole = written(recombine(partial), "trie-open")
    hashes = list_hashes(got.where(F.col("kind") == LIST))
    up = whole.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    open_nodes = (whole.join(hashes, "key", "left").join(up, "parent_key", "left")
                  .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))))
    closed = got.where(F.col("kind") == CLOSED)
    # A shard's open nodes with their whole figures: the lookup is by shard, so the children of a
    # popular node stay as spread as the shards are.
    here = partial.select("part", "seq", F.col("key").alias("parent_key")).join(up, "parent_key")
    looked = closed.where("parent_key is not null").drop("parent_conv_id").join(here, ["part", "seq", "parent_key"])
    inner = closed.where("parent_key is null")
    return open_nodes.select(*NODE).unionByName(looked.select(*NODE)).unionByName(inner.select(*NODE))
