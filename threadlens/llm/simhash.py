"""SimHash near-duplicates through a Gray-order hierarchical index (operator 2).

Fingerprints are made per document; equal ones collapse to one row. With ``d`` bits
of tolerance the 64 bits are cut into ``d + 2`` blocks, of which any two linked
fingerprints share at least two: one table per pair of blocks, whose two blocks
come first in a permuted fingerprint. A table is sorted by the Gray rank of the
permuted fingerprints. In that order fingerprints with equal leading bits stand
together, so an index node is a run of rows with a shared masked pattern: the
top nodes fix the two blocks, each lower level eight more bits, leaves all bits.
The search goes down pairs of nodes under one top node, adds up the differing
bits of the patterns level by level and drops a pair of nodes, with all
fingerprints below, once the sum passes ``d``.

A top node with many fingerprints is split before the tables are dealt: its rows
go to sub-tables that fix two more of the remaining blocks, again without losing
a pair, so a task never needs more than the rows that share 3/4 of all bits.

Links inside a node are reduced to a star per local component, and components
over all nodes come from alternating large-star and small-star rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, slices_by_bytes, stored, written

SHINGLE = 3
MAX_BITS = 2
# Fingerprints under one top node from which it is split by two more blocks.
SPLIT_ROWS = 512


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's ``k``-word shingles (ASCII lower case, ASCII blanks)."""
    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    h, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [h(join(w[i:i + k]), seed) for i in range(max(1, len(w) - k + 1))]
    return majority(np.array(hashes, "<u8"))


def majority(hashes) -> int:
    """Bits set in over half the hashes."""
    import numpy as np

    n = len(hashes)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    # Eight bits a lane: up to 255 rows can be added without a carry between them.
    lanes = np.add.reduceat(bits.view("<u8"), np.arange(0, n, 255), axis=0)
    counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), row by row, without a shuffle."""
    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for part in slices_by_bytes(batch, 1):
                fps = np.array([fingerprint(t, k) for t in part.column(1).to_pylist()], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps)], names=["doc_id", "fp"])

    src = pick(docs, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "text")
    return src.mapInArrow(work, "doc_id long, fp long")


def block_bounds(parts: int, lo: int = 0, hi: int = 64) -> list[tuple[int, int]]:
    """Cut bits ``lo`` to ``hi`` into ``parts`` runs (from the lowest bit)."""
    cuts = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    return list(zip(cuts, cuts[1:]))


def permutations(max_bits: int) -> list[list[tuple[int, int]]]:
    """For each table the bit runs from most to least significant: two blocks first."""
    blocks = block_bounds(max_bits + 2)
    return [[*pair, *[b for b in blocks if b not in pair]] for pair in combinations(blocks, 2)]


def permute(fp, runs: list[tuple[int, int]]):
    """Move bit runs of ``fp`` (unsigned numpy) to the top in the given order."""
    import numpy as np

    out, top = np.zeros_like(fp), 64
    for lo, hi in runs:
        top -= hi - lo
        out |= ((fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)) << np.uint64(top)
    return out


def gray_rank(v):
    """Place of ``v`` in the reflected Gray code: prefix parities from the top bit."""
    import numpy as np

    for s in (1, 2, 4, 8, 16, 32):
        v = v ^ (v >> np.uint64(s))
    return v


def keyed(fps: DataFrame, max_bits: int) -> DataFrame:
    """``tab, key, fp``: each fingerprint in each table, with its top node's pattern."""
    out = []
    for t, runs in enumerate(permutations(max_bits)):
        (a, b), (c, d) = runs[:2]
        cut = lambda lo, hi: f"(shiftrightunsigned(fp, {lo}) & {(1 << (hi - lo)) - 1}L)"
        out.append(F.struct(F.lit(t).alias("tab"), F.expr(
            f"shiftleft({cut(a, b)}, {d - c}) | {cut(c, d)}").alias("key")))
    return fps.select("fp", F.explode(F.array(*out)).alias("n")).select("n.tab", "n.key", "fp")


def split_hot(rows: DataFrame, max_bits: int, limit: int) -> DataFrame:
    """Drop top nodes of one fingerprint; give rows of large ones to sub-nodes.

    ``sub`` is -1 for a node left whole, else the number of a pair of parts of the
    remaining bits, and ``key`` gets those bits too. Two fingerprints under one
    node differ in ``max_bits`` of the remaining bits at most, so of their
    ``max_bits + 2`` parts two at least agree.
    """
    sizes = rows.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(stored(sizes), ["tab", "key"])
    whole = rows.where(F.col("n") <= limit).select(
        "tab", "key", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subkey"), "fp")
    hot = rows.where(F.col("n") > limit)
    parts = []
    for t, runs in enumerate(permutations(max_bits)):
        rest = [bit for lo, hi in runs[2:] for bit in range(lo, hi)]
        cuts = block_bounds(max_bits + 2, 0, len(rest))
        for s, pair in enumerate(combinations(cuts, 2)):
            mask = sum(1 << rest[i] for lo, hi in pair for i in range(lo, hi))
            mask -= (mask >> 63) << 64
            parts.append(F.when(F.col("tab") == t, F.struct(
                F.lit(s).alias("sub"), F.expr(f"fp & {mask}L" if mask != -(1 << 63) else "fp").alias("subkey"))))
    split = (hot.select("tab", "key", "fp", F.explode(F.array(*parts)).alias("n")).where("n is not null")
                .select("tab", "key", "n.sub", "n.subkey", "fp"))
    return whole.unionByName(split)


def node_links(fps, max_bits: int, tops):
    """Pairs of linked rows (smaller first). ``fps``: permuted fingerprints (unsigned) in
    Gray order within each top node; ``tops``: first row of each top node, and the end.

    A level's nodes are runs of rows, each named by its first row; a pair of nodes is
    the two names with the differing bits of the patterns seen so far (``acc``)."""
    import numpy as np

    n = len(fps)
    lo = np.asarray(tops[:-1])
    a, b, acc = lo.copy(), lo.copy(), np.zeros(len(lo), np.int64)
    start = np.zeros(n, bool)
    start[lo] = True
    level_start = lo
    shown = np.uint64(0)
    for depth in range(8, 65, 8):
        mask = np.uint64(((1 << depth) - 1) << (64 - depth))
        pat = fps & mask
        new = start.copy()
        new[1:] |= (pat[1:] != pat[:-1])
        first = np.flatnonzero(new)
        # A parent's children are first[p0:p1].
        p0 = np.searchsorted(first, level_start, "left")
        p1 = np.append(p0[1:], len(first))
        child_lo, child_hi = lookup(level_start, p0), lookup(level_start, p1)
        na0, na1, nb0, nb1 = child_lo(a), child_hi(a), child_lo(b), child_hi(b)
        ca, cb = na1 - na0, nb1 - nb0
        out_a, out_b, out_acc = [], [], []
        # Pairs of nodes are opened in portions, so that children of few are held at once.
        size = ca * cb
        cut = np.append(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + 1, 1 << 21), "left"), len(size))
        for x, y in zip(cut, cut[1:]):
            if x == y:
                continue
            s = size[x:y]
            which = np.repeat(np.arange(x, y), s)
            k = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
            ia, ib = first[na0[which] + k // cb[which]], first[nb0[which] + k % cb[which]]
            keep = ia <= ib
            which, ia, ib = which[keep], ia[keep], ib[keep]
            diff = acc[which] + np.bitwise_count((fps[ia] ^ fps[ib]) & mask & ~shown)
            keep = diff <= max_bits
            out_a.append(ia[keep]), out_b.append(ib[keep]), out_acc.append(diff[keep])
        empty = np.zeros(0, np.int64)
        a, b = np.concatenate(out_a or [empty]), np.concatenate(out_b or [empty])
        acc = np.concatenate(out_acc or [empty])
        start, level_start, shown = new, first, mask
    return a[a < b], b[a < b]


def lookup(keys, values):
    """Look values up by sorted keys that are known to be there."""
    import numpy as np

    return lambda x: values[np.searchsorted(keys, x)]


def stars(n: int, a, b):
    """For ``n`` rows linked by pairs ``a, b``: each row's smallest linked row (its component)."""
    import numpy as np

    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (label == before).all():
            break
    return label


def links(fps: DataFrame, max_bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Edges ``u, v`` (fingerprints) that connect exactly the components of the link graph."""
    tables = permutations(max_bits)

    def work(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def search(cols) -> pa.RecordBatch:
            tab, key, sub, subkey, fp = cols
            raw = fp.view("<u8")
            per = np.zeros_like(raw)
            for t, runs in enumerate(tables):
                at = tab == t
                per[at] = permute(raw[at], runs)
            order = np.lexsort((gray_rank(per), subkey, sub, key, tab))
            tab, key, sub, subkey, per, raw = (x[order] for x in (tab, key, sub, subkey, per, raw))
            new = np.ones(len(tab), bool)
            new[1:] = (tab[1:] != tab[:-1]) | (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (subkey[1:] != subkey[:-1])
            tops = np.append(np.flatnonzero(new), len(tab))
            a, b = node_links(per, max_bits, tops)
            label = stars(len(per), a, b)
            off = np.flatnonzero(label != np.arange(len(per)))
            return pa.RecordBatch.from_arrays(
                [pa.array(raw[label[off]].view("<i8")), pa.array(raw[off].view("<i8"))], names=["u", "v"])

        held = None
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            n = len(cols[0])
            last = np.ones(n, bool)
            for c in cols[:4]:
                last &= c == c[-1]
            cut = n - int(last.sum())  # the last node may go on in the next batch
            if cut:
                yield search([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None and len(held[0]):
            yield search(held)

    rows = split_hot(keyed(fps, max_bits), max_bits, split_rows)
    node = ["tab", "key", "sub", "subkey"]
    found = rows.repartition(*node).sortWithinPartitions(*node).mapInArrow(work, "u long, v long")
    return found.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges (long columns ``u, v``), where ``root`` is the
    component's smallest node: large-star and small-star rounds on checkpointed edges
    until nothing changes. Only counts reach the driver."""
    e = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lows, "u").select("u", "v", "m")
        e2 = small.select("u", F.col("m").alias("v")).unionByName(
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = stored(e2.where("u > v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                    max_bits: int = MAX_BITS, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """``doc_id, fp, root, component_id``: the component's smallest fingerprint (signed order) and
    the smallest ``doc_id`` reachable over fingerprints that differ in ``max_bits`` bits at most.

    A null or blank text has fingerprint zero, which links like any other. A null
    ``doc_id`` keeps its row and counts as larger than any number; a component of
    nulls only has a null id. Repeated rows stay. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, id_col, text_col, k), "simhash")
    heads = written(fps.groupBy("fp").agg(F.min("doc_id").alias("head")), "simhash-heads")
    comp = stored(components(links(heads.select("fp"), max_bits, split_rows)))
    in_comp = heads.join(comp, heads.fp == comp.node, "left").select(
        "fp", "head", F.coalesce("root", "fp").alias("root"))
    smallest = in_comp.groupBy("root").agg(F.min("head").alias("component_id"))
    ids = written(in_comp.join(smallest, "root").select("fp", "root", "component_id"), "simhash-ids")
    return fps.join(ids, "fp").select("doc_id", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE,
                max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` with one row of each component: that of the smallest id (nulls
    last), of rows with that id the one with the smallest text. All columns stay.

    Texts are not shuffled to find it, except those of rows whose id is null or repeated.
    """
    near = written(near_duplicates(docs, id_col, text_col, k, max_bits), "simhash-near")
    odd = stored(near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
                     .where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id")))
    key = F.col(f"`{id_col}`").cast("long")
    plain = near.where("doc_id = component_id").select(F.col("doc_id").alias("__id"))
    plain = plain.join(odd, "__id", "left_anti")
    kept = docs.join(plain, key == F.col("__id"), "left_semi")
    doubtful = docs.join(odd, key.eqNullSafe(F.col("__id")), "left_semi")
    if odd.isEmpty():
        return kept
    cols = doubtful.columns
    rows = doubtful.select(key.alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                           F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"))
    marked = _with_fp(rows, k).join(near.select("fp", "root", "component_id").distinct(), "fp")
    first = Window.partitionBy("root").orderBy("text")
    one = (marked.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                 .withColumn("__n", F.row_number().over(first)).where("__n = 1"))
    return kept.unionByName(one.select("row.*"))


def _with_fp(rows: DataFrame, k: int) -> DataFrame:
    """Add ``fp`` to the few rows that need it beside their other columns."""
    fp = F.udf(lambda t: fingerprint(t, k) - (1 << 64) * (fingerprint(t, k) >> 63), "long")
    return rows.withColumn("fp", fp("text"))
