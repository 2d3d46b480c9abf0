"""Topic models of many groups and many sizes, fitted together.

All models of a run are columns of one state: the topic weights of every size k of a (group,
term) stand side by side, so a pass over the corpus updates all of them. Documents are counted
in chunks where they stand and dealt once into parts of bounded size, each within one group; a
group's terms are dealt into buckets. A part is one row of packed counts. In a pass it gets the
weights of its own terms, one value from each bucket, runs the variational updates of its
documents in numpy, and sends each bucket its statistics, which are summed there. Neither
weights nor documents pass through the driver and nothing is broadcast; a part's memory follows
its own documents and terms, a bucket's the parts' terms in it, whatever the vocabulary.

Documents' mixtures travel the same way, so a pass begins where the last one ended and
needs few inner steps. Every pass is written to the shared checkpoint folder and takes the
place of the one before; its shuffle files go with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import drop_scratch, scratch_path
from .common import attach_scalars, materialize, pinned, release, shuffles_dropped

# Tokens that are counted at a time (one document at least), and document-term cells of a part at most
# (a part may hold one larger chunk).
CHUNK_TOKENS, PART_CELLS = 1 << 19, 8_000_000
# Bytes of statistics that a bucket gets from all parts, about.
BUCKET_BYTES = 32 << 20
# Cells whose topic weights are held at a time within a part.
STEP_CELLS = 8_192
# Inner steps of a pass; the next pass goes on where they end.
INNER_STEPS, TOLERANCE = 5, 1e-3
# A term's number: its bucket's number times this, and its place there.
BUCKET_STRIDE = 1 << 32
WEIGHT, MIXTURE = 0, 1


def grouped_counts(docs: DataFrame, no_below: int = 5, no_above: float = 0.5) -> DataFrame:
    """C8 within groups: ``g, doc, term, n`` of ``g, doc, tokens`` rows for terms whose documents
    in their group number between ``no_below`` and ``no_above`` of the group's."""
    sizes = docs.groupBy("g").agg(F.count(F.lit(1)).alias("_n"))
    counts = materialize(docs.select("g", "doc", F.explode("tokens").alias("term"))
                         .groupBy("g", "doc", "term").agg(F.count(F.lit(1)).cast("int").alias("n")))
    df = counts.groupBy("g", "term").agg(F.count(F.lit(1)).alias("df")).join(sizes, "g")
    kept = df.where((F.col("df") >= no_below) & (F.col("df") <= F.floor(F.col("_n") * no_above)))
    return counts.join(kept.select("g", "term"), ["g", "term"], "left_semi").select("g", "doc", "term", "n")


@dataclass
class Fitted:
    """Models of all groups: ``vocab`` (g, term_id, term), ``weights`` (g, term_id, v0..) and
    ``mixtures`` (g, doc, v0..); column ``v{i}`` belongs to topic ``topics[i]`` = (k, topic).
    ``heavy(n)`` has the rows of ``weights`` with one of a topic's ``n`` heaviest terms, at least."""

    ks: list[int]
    vocab: DataFrame
    weights: DataFrame
    mixtures: DataFrame
    heavy: object

    @property
    def topics(self) -> list[tuple[int, int]]:
        return [(k, t) for k in self.ks for t in range(k)]

    def long(self, df: DataFrame, *keys) -> DataFrame:
        """``keys, k, topic, weight``: a row per topic."""
        cells = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(t).alias("topic"), F.col(f"v{i}").alias("weight"))
                          for i, (k, t) in enumerate(self.topics)])
        return df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.*")

    def top_words(self, n: int = 20) -> DataFrame:
        """``g, k, topic, term`` of the ``n`` heaviest terms of every topic (ties by term)."""
        rows = self.long(self.heavy(n).join(self.vocab, ["g", "term_id"]), "g", "term")
        w = Window.partitionBy("g", "k", "topic").orderBy(F.desc("weight"), F.asc("term"))
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).drop("r", "weight")

    def phi(self) -> DataFrame:
        """``g, k, topic, term, phi``: term shares of every topic."""
        rows = self.long(self.weights.join(self.vocab, ["g", "term_id"]), "g", "term")
        total = rows.groupBy("g", "k", "topic").agg(F.sum("weight").alias("_w"))
        return rows.join(total, ["g", "k", "topic"]).select("g", "k", "topic", "term", (F.col("weight") / F.col("_w")).alias("phi"))

    def theta(self, k: int) -> DataFrame:
        """``g, doc, theta`` (array<double> that sums to 1) for the models of size ``k``."""
        return self.mixtures.select("g", "doc", self.theta_column(k).alias("theta"))

    def theta_column(self, k: int) -> F.Column:
        own = [F.col(f"v{i}").cast("double") for i, (size, _) in enumerate(self.topics) if size == k]
        total = sum(own[1:], own[0])
        return F.array(*[c / total for c in own])


def digamma(x):
    """Digamma of positive numbers: six steps of the recurrence, then the asymptotic series."""
    import numpy as np

    shift = sum(1.0 / (x + i) for i in range(6))
    y = x + 6.0
    z = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z / 252)) - shift


def like_sizes(size, cells: int):
    """Documents in groups of like size, each with about ``cells`` cells (one document at least)."""
    import numpy as np

    by = np.argsort(size, kind="stable")
    ordered = size[by]
    lo = 0
    while lo < len(by):
        m = max(int(ordered[lo] * 1.125), int(ordered[lo]) + 3)
        hi = max(lo + 1, min(int(np.searchsorted(ordered, m, "right")), lo + max(1, cells // m)))
        yield by[lo:hi]
        lo = hi


def dealt(beta, counts, terms, starts, size):
    """Documents' cells side by side: ``at`` (documents x longest; cells past a document's end count 0),
    their ``weights`` (documents x topics x longest) and ``n``."""
    import numpy as np

    place = np.arange(int(size.max()))
    past = place >= size[:, None]
    at = np.where(past, starts[:, None], starts[:, None] + place)
    n = counts[at].astype(np.float32)
    n[past] = 0
    return terms[at], np.ascontiguousarray(beta[terms[at]].transpose(0, 2, 1)), n


def mixed(gamma, ks):
    """``exp(E[log theta])`` of mixtures whose columns are those of the models ``ks``."""
    import numpy as np

    firsts = np.cumsum([0, *ks[:-1]])
    total = np.repeat(np.add.reduceat(gamma, firsts, axis=1), ks, axis=1)
    return np.exp(digamma(gamma) - digamma(total)).astype(np.float32)


def ratios(t, b, n, ks):
    """``n / sum_k theta_k beta_k`` of each model (models x documents x 1 x cells), and its sums times
    ``beta`` over a document's cells (documents x topics)."""
    import numpy as np

    out = np.empty((len(ks), len(n), 1, n.shape[1]), np.float32)
    sums = np.empty((*t.shape, 1), np.float32)
    lo = 0
    for i, k in enumerate(ks):
        own = slice(lo, lo + k)
        np.matmul(t[:, None, own], b[:, own], out=out[i])
        np.maximum(out[i], 1e-30, out=out[i])
        np.divide(n[:, None], out[i], out=out[i])
        np.matmul(b[:, own], out[i].transpose(0, 2, 1), out=sums[:, own])
        lo += k
    return out, sums[:, :, 0]


def update(counts, terms, doc, log_beta, gamma, ks):
    """One variational update of documents with fixed topics (Blei, Ng, Jordan 2003).

    ``counts, terms, doc`` are cells sorted by document (numbers from 0; a document has a term
    once), ``log_beta`` (terms x topics) the expected log weights, ``gamma`` (documents x topics)
    the mixtures to start from. Returns new mixtures and the cells' summed statistics (terms x
    topics, without the factor ``exp(log_beta)``).
    """
    import numpy as np

    alpha = np.repeat([1.0 / k for k in ks], ks).astype(np.float32)
    model = np.repeat(np.arange(len(ks)), ks)
    beta = np.exp(log_beta).astype(np.float32)
    gamma = gamma.copy()
    stats = np.zeros(beta.shape, np.float32)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    size = np.diff(np.append(starts, len(doc)))
    numbers = doc[starts]
    for some in like_sizes(size, STEP_CELLS):
        at, b, n = dealt(beta, counts, terms, starts[some], size[some])
        g = gamma[numbers[some]]
        for _ in range(INNER_STEPS):
            t = mixed(g, ks)
            ratio, sums = ratios(t, b, n, ks)
            new = alpha + t * sums
            moved = float(np.abs(new - g).mean())
            g = new
            if moved < TOLERANCE:
                break
        gamma[numbers[some]] = g
        each = np.ascontiguousarray(ratio[:, :, 0].transpose(1, 2, 0))
        for i, m in enumerate(size[some].tolist()):
            stats[at[i, :m]] += each[i, :m][:, model] * t[i]
    return gamma, stats


def packed(a):
    """Bytes of an integer array, plane by plane, compressed; :func:`unpacked` takes its length."""
    import numpy as np
    import pyarrow as pa

    width = 1 if not len(a) or int(a.max()) < 256 else 4
    planes = np.ascontiguousarray(a.astype(np.uint8 if width == 1 else np.int32)).view(np.uint8).reshape(-1, width).T
    return bytes([width]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob, size: int):
    import numpy as np
    import pyarrow as pa

    width = blob[0]
    planes = np.frombuffer(pa.decompress(blob[1:], size * width, codec="zstd", asbytes=True), np.uint8).reshape(width, -1)
    return planes[0] if width == 1 else np.ascontiguousarray(planes.T).reshape(-1).view(np.int32)


_CHUNK = "chunk long, g long, docs long, cells long, doc binary, size binary, term binary, n binary, terms array<string>, df array<int>"


def _chunks(docs: DataFrame) -> DataFrame:
    """``g, doc, tokens, ns`` rows (``ns`` tells how often a token stands there, NULL: once) counted as they stand,
    about :data:`CHUNK_TOKENS` tokens of a group at a time."""
    most, pack = CHUNK_TOKENS, packed

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        held: dict = {}

        def counted(g, rows):
            nonlocal chunk
            ids, lists, ns = (pa.chunked_array(x).combine_chunks() for x in zip(*rows))
            # Documents in the order of their numbers, however they came.
            ids = ids.to_numpy().astype(np.int64)
            order = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            row = rank[pc.list_parent_indices(lists).to_numpy()]
            times = pc.list_flatten(pc.if_else(pc.is_null(ns), pa.scalar([], ns.type), ns)).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            if len(times) != len(flat):
                times = np.ones(len(flat), np.int64)
            known = pc.is_valid(flat)
            row, times = row[known.to_numpy(zero_copy_only=False)], times[known.to_numpy(zero_copy_only=False)]
            code = flat.filter(known).dictionary_encode()
            width = max(len(code.dictionary), 1)
            key, at = np.unique(row * width + code.indices.to_numpy(), return_inverse=True)
            n, term, own = np.bincount(at, weights=times, minlength=len(key)).astype(np.int64), key % width, key // width
            size = np.bincount(own, minlength=len(ids))
            df = np.bincount(term, minlength=len(code.dictionary)).astype(np.int32)
            kinds = [pa.int64()] * 4 + [pa.binary()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int32())]
            values = [chunk, g, len(ids), len(key), ids[order].tobytes(), pack(size), pack(term), pack(n)]
            whole = [pa.array([v], t) for v, t in zip(values, kinds)]
            whole += [pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), x) for x in (code.dictionary, pa.array(df))]
            chunk += 1
            return pa.RecordBatch.from_arrays(whole, names=[x.split()[0] for x in _CHUNK.split(", ")])

        tokens = 0
        for batch in batches:
            total = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(2)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most - tokens, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                groups = part.column(0).to_numpy()
                for g in np.unique(groups).tolist():
                    rows = part.filter(pa.array(groups == g))
                    held.setdefault(g, []).append(rows.columns[1:])
                tokens += int(total[hi] - total[lo])
                lo = hi
                if tokens >= most or lo < batch.num_rows:
                    for g, rows in held.items():
                        yield counted(g, rows)
                    held, tokens = {}, 0
        for g, rows in held.items():
            yield counted(g, rows)

    return materialize(docs.select("g", "doc", "tokens", "ns").mapInArrow(work, _CHUNK))


_PART = "p long, g long, docs long, cells long, doc binary, size binary, term binary, n binary, buckets binary, places binary"


def _parts(chunks: DataFrame, terms: DataFrame, deal: DataFrame, tasks: int) -> DataFrame:
    """Parts of the chunks that ``deal`` (chunk, p, buckets) gives them: counts of the terms of ``terms`` (chunk, code,
    j, place). A part's terms are in the order of their buckets ``j`` and places there."""
    pack, unpack = packed, unpacked

    def step(own, known):
        import numpy as np
        import pyarrow as pa

        number = (known["j_"].to_numpy().astype(np.int64) * BUCKET_STRIDE + known["place_"].to_numpy()).astype(np.int64)
        ids, at = np.unique(number, return_inverse=True)
        from_chunk, code = known["chunk_"].to_numpy(), known["code_"].to_numpy()
        out: dict = {x: [] for x in ("doc", "size", "term", "n")}
        for r in own.select(["chunk", "docs", "cells", "doc", "size", "term", "n"]).sort_by("chunk").to_pylist():
            mine = from_chunk == r["chunk"]
            place = np.full(int(code[mine].max()) + 1 if mine.any() else 0, -1, np.int64)
            place[code[mine]] = at[mine]
            size, term, n = unpack(r["size"], r["docs"]), unpack(r["term"], r["cells"]), unpack(r["n"], r["cells"])
            doc = np.repeat(np.arange(r["docs"]), size)
            new = np.full(len(term), -1, np.int64)
            inside = term < len(place)
            new[inside] = place[term[inside]]
            kept = np.flatnonzero(new >= 0)
            # A document's terms in the part's order.
            kept = kept[np.lexsort((new[kept], doc[kept]))]
            size = np.bincount(doc[kept], minlength=r["docs"])
            out["doc"].append(np.frombuffer(r["doc"], np.int64)[size > 0])
            out["size"].append(size[size > 0].astype(np.int32))
            out["term"].append(new[kept].astype(np.int32))
            out["n"].append(n[kept].astype(np.int32))
        whole = {x: np.concatenate(v) for x, v in out.items()}
        buckets = np.bincount(ids // BUCKET_STRIDE, minlength=own["buckets"][0].as_py()).astype(np.int32)
        places = (ids % BUCKET_STRIDE).astype(np.int32)
        values = [own["p"][0].as_py(), own["g"][0].as_py(), len(whole["doc"]), len(whole["term"]), whole["doc"].tobytes(),
                  pack(whole["size"]), pack(whole["term"]), pack(whole["n"]), buckets.tobytes(), places.tobytes()]
        names, kinds = [x.split()[0] for x in _PART.split(", ")], [pa.int64()] * 4 + [pa.binary()] * 6
        return pa.table({x: pa.array([v] if len(whole["doc"]) else [], t) for x, v, t in zip(names, values, kinds)})

    own = chunks.join(deal, "chunk").select("p", "chunk", "g", "buckets", "docs", "cells", "doc", "size", "term", "n")
    # Named anew: both sides come from the same chunks.
    known = terms.join(deal.select("chunk", F.col("p").alias("of")), "chunk").select(
        *[F.col(c).alias(f"{c}_") for c in ("of", "chunk", "code", "j", "place")])
    made = own.groupBy("p").cogroup(known.groupBy("of_")).applyInArrow(step, _PART)
    return pinned(made.repartition(tasks, "p"))


_SENT = "kind int, g long, j int, p long, ids binary, v binary"


def _asks(parts: DataFrame) -> DataFrame:
    """For every part and bucket of its group a row that asks for weights."""
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                buckets, places = np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["places"], np.int32)
                ends = np.cumsum(buckets)
                ids = [places[e - n:e].tobytes() for e, n in zip(ends, buckets)]
                m = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([WEIGHT] * m, pa.int32()), pa.array([r["g"]] * m, pa.int64()), pa.array(range(m), pa.int32()),
                     pa.array([r["p"]] * m, pa.int64()), pa.array(ids, pa.binary()), pa.nulls(m, pa.binary())],
                    names=["kind", "g", "j", "p", "ids", "v"])

    return parts.select("p", "g", "buckets", "places").mapInArrow(work, _SENT)


def _bucket_weights(table, ks):
    """Weights (places x topics) of a bucket from what was sent to it, in the order of the parts: the first ones as they
    are given (with no part), else the parts' statistics and the prior."""
    import numpy as np

    width = sum(ks)
    table = table.sort_by("p")
    places = [np.frombuffer(x, np.int32) for x in table["ids"].to_pylist()]
    total = np.zeros((1 + max((int(x.max()) for x in places if len(x)), default=-1), width))
    given = False
    for i, at in enumerate(places):
        v = table["v"][i].as_py()
        if v is not None:
            total[at] += np.frombuffer(v, np.float32).reshape(-1, width)
            given |= table["p"][i].as_py() is None
    if not given:
        total += np.repeat([1.0 / k for k in ks], ks)
    return table, places, total.astype(np.float32)


def _answers(sent: DataFrame, ks: list[int]) -> DataFrame:
    """``of, j, kind, v, total``: to every part the weights of its terms in a bucket, and the sums over the bucket."""
    weights_of = _bucket_weights

    def work(table):
        import numpy as np
        import pyarrow as pa

        table, places, weights = weights_of(table, ks)
        total = weights.sum(axis=0, dtype=np.float64).tobytes()
        own = [(p, weights[at].tobytes()) for p, at in zip(table["p"].to_pylist(), places) if p is not None]
        return pa.table({"of": pa.array([p for p, _ in own], pa.int64()), "j": pa.array([table["j"][0].as_py()] * len(own), pa.int32()),
                         "kind": pa.array([WEIGHT] * len(own), pa.int32()), "v": pa.array([v for _, v in own], pa.binary()),
                         "total": pa.array([total] * len(own), pa.binary())})

    return sent.groupBy("g", "j").applyInArrow(work, "of long, j int, kind int, v binary, total binary")


def _weight_rows(sent: DataFrame, ks: list[int], n: int | None = None) -> DataFrame:
    """``g, term_id, v0..``: a row per term, or with ``n`` per term that is among a bucket's ``n`` heaviest of a topic."""
    weights_of, names = _bucket_weights, [f"v{i}" for i in range(sum(ks))]

    def work(table):
        import numpy as np
        import pyarrow as pa

        table, _, weights = weights_of(table, ks)
        at = np.arange(len(weights))
        if n is not None and n < len(at):
            # Places follow the terms' order, which breaks ties.
            at = np.unique(np.argsort(-weights, axis=0, kind="stable")[:n])
        g, j = (table[x][0].as_py() for x in ("g", "j"))
        return pa.table({"g": pa.array(np.full(len(at), g, np.int64)), "term_id": pa.array(j * BUCKET_STRIDE + at.astype(np.int64)),
                         **{c: pa.array(weights[at, i]) for i, c in enumerate(names)}})

    return sent.groupBy("g", "j").applyInArrow(work, "g long, term_id long, " + ", ".join(f"{c} float" for c in names))


def _pass(parts: DataFrame, state: DataFrame, ks: list[int], learn: bool) -> DataFrame:
    """One pass over all parts: statistics for the buckets and the new mixtures."""
    unpack, width = unpacked, sum(ks)

    def step(own, got):
        import numpy as np
        import pyarrow as pa

        names, kinds = [x.split()[0] for x in _SENT.split(", ")], [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        if not own.num_rows:
            return pa.table({x: pa.array([], t) for x, t in zip(names, kinds)})
        r = own.to_pylist()[0]
        got = got.sort_by([("kind", "ascending"), ("j", "ascending")])
        kind, blobs = got["kind"].to_pylist(), got["v"].to_pylist()
        weights = np.frombuffer(b"".join(v for v, t in zip(blobs, kind) if t == WEIGHT), np.float32).reshape(-1, width)
        totals = sum(np.frombuffer(v) for v, t in zip(got["total"].to_pylist(), kind) if t == WEIGHT)
        log_beta = np.empty(weights.shape, np.float32)
        base = digamma(totals.astype(np.float32).astype(np.float64))
        for lo in range(0, len(weights), 10_000):
            log_beta[lo:lo + 10_000] = digamma(weights[lo:lo + 10_000].astype(np.float64)) - base
        del weights
        size = unpack(r["size"], r["docs"]).astype(np.int64)
        counts, terms = unpack(r["n"], r["cells"]), unpack(r["term"], r["cells"])
        doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        old = [v for v, t in zip(blobs, kind) if t == MIXTURE]
        if old:
            gamma = np.frombuffer(old[0], np.float32).reshape(-1, width)
        else:
            length = np.add.reduceat(counts.astype(np.int64), np.cumsum(size) - size)
            gamma = (np.repeat([1.0 / k for k in ks], ks) * (1 + length[:, None])).astype(np.float32)
        del blobs, got
        gamma, stats = update(counts, terms, doc, log_beta, gamma, ks)
        out = [(MIXTURE, r["g"], -1, r["p"], r["doc"], gamma.tobytes())]
        if learn:
            stats *= np.exp(log_beta)
            lo = 0
            places = np.frombuffer(r["places"], np.int32)
            for j, n in enumerate(np.frombuffer(r["buckets"], np.int32).tolist()):
                out.append((WEIGHT, r["g"], j, r["p"], places[lo:lo + n].tobytes(), stats[lo:lo + n].tobytes()))
                lo += n
        return pa.table({x: pa.array(v, t) for x, v, t in zip(names, zip(*out), kinds)})

    return parts.groupBy("p").cogroup(state.groupBy("of")).applyInArrow(step, _SENT)


def fit_batch(counts: DataFrame, ks, passes: int = 8, seed: int = 42, infer: bool = True) -> Fitted:
    """:func:`fit_documents` of ``g, doc, term, n`` rows, over all their terms."""
    docs = counts.groupBy(F.col("g").cast("long").alias("g"), F.col("doc").cast("long").alias("doc")).agg(
        F.collect_list(F.struct("term", F.col("n").cast("int").alias("n"))).alias("c"))
    return fit_documents(docs.select("g", "doc", F.col("c.term").alias("tokens"), F.col("c.n").alias("ns")),
                         ks, passes, seed, infer)


def fit_documents(docs: DataFrame, ks, passes: int = 8, seed: int = 42, infer: bool = True, terms: DataFrame | None = None,
                  bounds: tuple | None = None) -> Fitted:
    """Fit a topic model for every group of ``g, doc, tokens`` rows and every k of ``ks``: variational
    Bayes over the whole corpus, symmetric priors 1/k, ``passes`` passes, then the
    documents' mixtures under the final topics.

    ``g`` and ``doc`` are longs (a document stands in one group, in one row). The terms are all
    tokens, those of ``terms`` (term), or with ``bounds`` (no_below, no_above) those whose documents
    in their group number between ``no_below`` and ``no_above`` of the group's (C8). First weights
    follow from the term, the seed and the column alone, so a run can be repeated. A document without
    a counted term has no row; no rows, no models. Without ``infer`` the last step is left out, and
    the mixtures are those of the last pass.
    """
    ks = sorted(set(ks))
    if not ks or ks[0] < 1:
        raise ValueError("topic models need at least one k of 1 or more")
    spark = docs.sparkSession
    names = [f"v{i}" for i in range(sum(ks))]
    if "ns" not in docs.columns:
        docs = docs.withColumn("ns", F.lit(None).cast("array<int>"))
    with shuffles_dropped(spark):
        chunks = _chunks(docs)
        kept = chunks.select("g", F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy(
            "g", F.col("t.terms").alias("term")).agg(F.sum("t.df").alias("df"))
        if terms is not None:
            kept = kept.join(terms.select("term").distinct(), "term", "left_semi")
        if bounds is not None:
            sizes = chunks.groupBy("g").agg(F.sum("docs").alias("_n"))
            kept = kept.join(sizes, "g").where((F.col("df") >= bounds[0]) & (F.col("df") <= F.floor(F.col("_n") * bounds[1])))
        kept = materialize(kept.select("g", "term", "df"))
        cells = kept.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("c")).first().c
        limit = max(1, min(PART_CELLS, cells // spark.sparkContext.defaultParallelism))
        groups = materialize(kept.groupBy("g").agg(F.ceil(F.sum("df") / F.lit(limit)).alias("_parts"), F.count(F.lit(1)).alias("_terms")).select(
            "g", "_parts", F.ceil(F.col("_terms") * F.col("_parts") * F.lit(4 * len(names) / BUCKET_BYTES)).cast("int").alias("_buckets")))
        tasks = 2 * int(groups.agg(F.coalesce(F.sum("_parts"), F.lit(1))).first()[0])
        # Numbered once and written, so a term keeps its number.
        place = F.row_number().over(Window.partitionBy("g", "j").orderBy("term")) - 1
        vocab = kept.join(groups, "g").select("g", "term", F.pmod(F.xxhash64("term"), F.col("_buckets")).cast("int").alias("j"))
        vocab = materialize(vocab.withColumn("place", place))
        # The largest chunks first, one to a part after the other.
        turn = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("cells"), "chunk")) - 1
        deal = materialize(chunks.select("chunk", "g", "cells").withColumn("turn", turn).join(groups, "g").select(
            "chunk", F.xxhash64("g", F.pmod(F.col("turn"), F.col("_parts"))).alias("p"), F.col("_buckets").alias("buckets")))
        coded = chunks.select("chunk", "g", F.posexplode("terms").alias("code", "term")).join(vocab, ["g", "term"])
        parts = _parts(chunks, coded.select("chunk", "code", "j", "place"), deal, tasks)
        release(chunks)

        def unit(i: int) -> F.Column:
            return F.pmod(F.xxhash64("term", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / F.lit(float(1 << 20))

        # A mean of 1 and a standard deviation of 0.1.
        first = vocab.select("g", "j", "place", *[(1 + (unit(i) - 0.5) * 0.34641).cast("float").alias(c) for i, c in enumerate(names)])
        sent = _asks(parts).unionByName(_given(first, names))
        mixtures = before = None
        for n in range(passes + infer):
            learn = n < passes
            state = _answers(sent, ks)
            if mixtures is not None:
                state = state.unionByName(mixtures.select(F.col("p").alias("of"), "j", "kind", "v", F.lit(None).cast("binary").alias("total")))
            path = scratch_path(spark, "topic-pass")
            out = _pass(parts, state, ks, learn)
            # Weights hardly repeat: a dictionary would only cost time.
            out.write.option("parquet.enable.dictionary", "false").parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
            # The last step's weights are still those of the pass before it.
            if before and learn:
                drop_scratch(spark, before)
            before = path
            mixtures = out.where(F.col("kind") == MIXTURE)
            if learn:
                sent = out.where(F.col("kind") == WEIGHT)
    number = (F.col("j").cast("long") * F.lit(BUCKET_STRIDE) + F.col("place")).alias("term_id")
    return Fitted(ks, vocab.select("g", number, "term"), _weight_rows(sent, ks), _mixture_rows(mixtures, names),
                  lambda n: _weight_rows(sent, ks, n))


def _given(rows: DataFrame, names: list[str]) -> DataFrame:
    """First weights (g, j, place, v0..) as sent to their buckets by no part."""
    def work(table):
        import numpy as np
        import pyarrow as pa

        v = np.column_stack([table[c].to_numpy() for c in names]).astype(np.float32)
        return pa.table({"kind": pa.array([WEIGHT], pa.int32()), "g": table["g"][:1], "j": table["j"][:1], "p": pa.nulls(1, pa.int64()),
                         "ids": pa.array([table["place"].to_numpy().astype(np.int32).tobytes()], pa.binary()),
                         "v": pa.array([v.tobytes()], pa.binary())})

    return rows.groupBy("g", "j").applyInArrow(work, _SENT)


def _mixture_rows(mixtures: DataFrame, names: list[str]) -> DataFrame:
    """``g, doc, v0..`` of the parts' mixtures."""
    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for g, ids, v in zip(*(batch.column(i).to_pylist() for i in range(3))):
                doc, rows = np.frombuffer(ids, np.int64), np.frombuffer(v, np.float32).reshape(-1, len(names))
                for lo in range(0, len(doc), 10_000):
                    some = rows[lo:lo + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), g, np.int64)), pa.array(doc[lo:lo + 10_000]), *(pa.array(some[:, i]) for i in range(len(names)))],
                        names=["g", "doc", *names])

    return mixtures.select("g", "ids", "v").mapInArrow(work, "g long, doc long, " + ", ".join(f"{c} float" for c in names))


# Numbers of models and topics in one coherence pass: a model is group and k, a topic's number in it last.
TOPIC_STRIDE = 10_000


def coherence_of(fitted: Fitted, texts: DataFrame, topn: int = 20) -> DataFrame:
    """``g, k, coherence``: mean c_v over each model's topics; ``texts`` are ``g, tokens`` rows."""
    from .coherence import grouped_coherence

    words = materialize(fitted.top_words(topn).select(
        "g", (F.col("topic") + F.col("k") * TOPIC_STRIDE).alias("topic"), "term"))
    per = grouped_coherence(texts, words, "tokens", stride=TOPIC_STRIDE)
    return per.groupBy("g", F.floor(F.col("topic") / TOPIC_STRIDE).cast("int").alias("k")).agg(
        F.avg("coherence").alias("coherence"))


def best_ks(scores: DataFrame) -> DataFrame:
    """``g, k`` of highest coherence, ties to the smallest k."""
    best = F.max(F.struct(F.coalesce("coherence", F.lit(float("-inf"))).alias("c"), (-F.col("k")).alias("k"))).alias("b")
    return scores.groupBy("g").agg(best).select("g", (-F.col("b.k")).alias("k"))


def scored(fitted: Fitted, texts: DataFrame, topn: int = 20) -> DataFrame:
    """``k, coherence, best`` of the models of one corpus (group 0), the best flagged."""
    scores = materialize(coherence_of(fitted, texts, topn))
    top = best_ks(scores).agg(F.max("k").alias("_best"))
    return attach_scalars(scores, top).select("k", "coherence", (F.col("k") == F.col("_best")).alias("best"))
