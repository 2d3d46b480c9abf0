"""Phrase learning and greedy phrase merging.

Learning: every token is a unigram key and every adjacent pair "a_b" a
bigram key of one count dictionary (the same string can arise both ways and
then shares one count). A multi-part key k = p1_..._pn is a phrase when
    (count(k) - min_count) * |dictionary| / (count(p1) * count(pn)) > threshold.
All of this is partial aggregates over exploded tokens/pairs plus joins;
pairs come from ``arrays_zip`` of shifted slices, so no window is needed.

Merging: left-to-right and non-overlapping. Position i "qualifies" when
tokens i and i+1 join into a phrase key. In a run of consecutive qualifying
positions (an island) the greedy scan takes the 1st, 3rd, 5th ... one; a
token is emitted unless its predecessor was taken. With a phrase table of
bounded bytes this happens inside the row (Arrow batches, nothing is shuffled);
with a larger one the island start comes from a running max over a window
partitioned by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_scalars, broadcast_if_small, materialize, release, shuffles_dropped

DELIM = "_"
# Bytes of phrase keys that a task may hold, and tokens that it merges at a time.
HELD_BYTES, HELD_TOKENS = 64 << 20, 1 << 20
# Tokens that a task counts at a time, and counts that a task sums.
COUNTED_TOKENS, KEYS_A_TASK = 1 << 21, 1 << 20
# Ends the number of a token's group in grouped learning.
GROUP_END = "\x1f"


def _pairs(tokens) -> F.Column:
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    n = F.size(t)
    return F.when(n >= 2, F.arrays_zip(F.slice(t, 1, n - 1).alias("a"), F.slice(t, 2, n - 1).alias("b"))) \
            .otherwise(F.array().cast("array<struct<a:string,b:string>>"))


def counted_keys(tokens):
    """``key, count`` of the tokens and adjacent pairs of a list array (a key may come twice, as a token and
    as a pair). A null token is a null key; like concat_ws, a pair leaves a null part and its delimiter out."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    flat = tokens.flatten()
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = np.zeros(len(flat), bool)
    ends[np.cumsum(size, dtype=np.int64)[size > 0] - 1] = True
    joins = ~ends[:-1]
    # Pairs are counted by their words' numbers and written out once each; the last number is a null.
    coded = flat.dictionary_encode()
    words = pa.concat_arrays([coded.dictionary, pa.nulls(1, flat.type)])
    code = pc.fill_null(coded.indices, len(words) - 1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.bincount(code, minlength=len(words))
    single = np.flatnonzero(n)
    both, times = np.unique(code[:-1][joins] * len(words) + code[1:][joins], return_counts=True)
    a, b = (words.take(pa.array(x)) for x in np.divmod(both, len(words)))
    pair = pc.binary_join_element_wise(pc.fill_null(a, ""), pc.fill_null(b, ""), DELIM)
    pair = pc.if_else(pc.is_null(a), pc.fill_null(b, ""), pc.if_else(pc.is_null(b), a, pair))
    return pa.concat_arrays([words.take(pa.array(single)), pair]), pa.array(np.concatenate([n[single], times]).astype(np.int64))


def count_dictionary(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(key, count) over unigram keys and joined adjacent-pair keys.

    Tasks count :data:`COUNTED_TOKENS` tokens at a time, so that none holds the keys of all its
    rows; the counts are summed in as many tasks as their number asks for (:data:`KEYS_A_TASK`)."""
    return _summed(_counted(docs, tokens_col))


def _summed(some: DataFrame) -> DataFrame:
    tasks = max(int(some.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + some.count() // KEYS_A_TASK)
    return some.repartition(tasks, "key").groupBy("key").agg(F.sum("n").alias("count"))


def _counted(docs: DataFrame, tokens_col: str) -> DataFrame:
    """``key, n`` of so many tokens at a time, written."""
    count, most = counted_keys, COUNTED_TOKENS

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held, n = [], 0

        def counts():
            return pa.RecordBatch.from_arrays([*count(pa.concat_arrays(held))], names=["key", "n"])

        for batch in batches:
            column = batch.column(0)
            total = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < len(column):
                before = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, before + most - n, "right")))
                held.append(column.slice(lo, hi - lo))
                n += int(total[hi - 1] - before)
                lo = hi
                if n >= most or lo < len(column):  # full, or the next row is too long for what is left
                    yield counts()
                    held, n = [], 0
        if held:
            yield counts()

    return materialize(docs.select(F.col(tokens_col).cast("array<string>")).mapInArrow(work, "key string, n long"))


def learn_phrases(docs: DataFrame, tokens_col: str = "tokens", min_count: int = 5,
                  threshold: float = 10.0, grouped: bool = False) -> DataFrame:
    """Phrase table (phrase, first, last, count, score) with score > threshold.

    With ``grouped`` every token begins with its group's number and :data:`GROUP_END`, and
    the dictionary's size is that of the group; phrases of all groups are learned at once.

    The count dictionary is materialised once. A key's first/last parts never
    contain the delimiter, so their counts come from the plain-token part of
    the dictionary (vocabulary-sized, broadcast after a size check). With a
    non-negative threshold only keys counted more than ``min_count`` times can
    score above it: rarer pairs only count towards the dictionary's size, so they are
    written without their key. The result is materialised too: it is small and every
    merge pass reads it.
    """
    plain_key = ~F.col("key").contains(DELIM)
    used = plain_key | (F.col("count") > min_count) if threshold >= 0 else F.lit(True)
    group = F.substring_index("key", GROUP_END, 1) if grouped else F.lit("")
    # What was counted is deleted once it is summed, the dictionary once the phrases are written.
    counted = _counted(docs, tokens_col)
    with shuffles_dropped(docs.sparkSession):
        vocab = materialize(_summed(counted).select(
            group.alias("_g"), F.when(used, F.col("key")).alias("key"), F.when(used, F.col("count")).alias("count")))
    release(counted)
    size = vocab.agg(F.count(F.lit(1)).alias("_v")) if not grouped else \
        vocab.groupBy("_g").agg(F.count(F.lit(1)).alias("_v"))
    parts = F.split("key", DELIM)
    multi = vocab.filter(F.size(parts) >= 2)
    if threshold >= 0:
        multi = multi.filter(F.col("count") > min_count)
    multi = multi.select(F.col("key").alias("phrase"), F.col("count").alias("n_ab"),
                         F.element_at(parts, 1).alias("first"), F.element_at(parts, -1).alias("last"))
    plain = broadcast_if_small(vocab.filter(plain_key).select("key", "count"))
    uni_a = plain.select(F.col("key").alias("first"), F.col("count").alias("n_a"))
    uni_b = plain.select(F.col("key").alias("last"), F.col("count").alias("n_b"))
    j = multi.join(uni_a, "first").join(uni_b, "last")
    j = attach_scalars(j, size) if not grouped else \
        j.withColumn("_g", F.substring_index("phrase", GROUP_END, 1)).join(size, "_g")
    score = (F.col("n_ab") - F.lit(min_count)).cast("double") / (F.col("n_a") * F.col("n_b")).cast("double") \
        * F.col("_v")
    out = materialize(j.withColumn("score", score).filter(F.col("score") > threshold)
                      .select("phrase", "first", "last", F.col("n_ab").alias("count"), "score"))
    release(vocab)
    return out


def merge_phrases(docs: DataFrame, phrases: DataFrame, doc_col: str, tokens_col: str = "tokens",
                  out: str | None = None) -> DataFrame:
    """Apply a phrase table greedily left to right; returns (``doc_col``, ``out``).

    A table of at most :data:`HELD_BYTES` goes to every task and rows stay where they are.
    With a larger one the token stream is shuffled once by document (for the ordered scan);
    the regrouping reuses that partitioning. Documents without tokens come back with an
    empty array.
    """
    out = out or tokens_col
    if _held_bytes(phrases) <= HELD_BYTES:
        return _merged_in_rows(docs, [phrases], doc_col, tokens_col, out)
    return _merged_by_window(docs, phrases, doc_col, tokens_col, out)


def _held_bytes(phrases: DataFrame) -> int:
    return phrases.agg(F.coalesce(F.sum(F.octet_length("phrase") + 16), F.lit(0)).alias("b")).first().b


def merged_tokens(tokens, phrases):
    """A list array with phrases merged (``phrases``: a string array). Null tokens go, a null list
    is an empty one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    flat = tokens.flatten()
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    n = len(flat)
    if not n:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), flat)
    place = np.arange(n)
    ends = np.zeros(n, bool)
    ends[at[1:][size > 0] - 1] = True
    after = pa.concat_arrays([flat[1:], pa.nulls(1, flat.type)])
    # Like concat_ws: a null part and its delimiter are left out.
    both = pc.binary_join_element_wise(pc.fill_null(flat, ""), pc.fill_null(after, ""), DELIM)
    key = pc.if_else(pc.is_null(flat), after, pc.if_else(pc.is_null(after), flat, both))
    joins = pc.is_in(key, value_set=phrases).to_numpy(zero_copy_only=False).astype(bool)
    joins &= ~ends & pc.is_valid(after).to_numpy(zero_copy_only=False)
    start = np.maximum.accumulate(np.where(joins, -1, place))
    picked = joins & ((place - start) % 2 == 1)
    kept = ~np.concatenate([[False], picked[:-1]])
    word = pc.if_else(pa.array(picked), key, flat)
    kept &= pc.is_valid(word).to_numpy(zero_copy_only=False)
    cuts = np.concatenate([[0], np.cumsum(kept)])[at]
    return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), word.filter(pa.array(kept)))


def _merged_in_rows(docs: DataFrame, tables: list, doc_col: str, tokens_col: str, out: str, unmarked: bool = False) -> DataFrame:
    """The phrase tables applied one after the other; with ``unmarked`` group numbers are taken off in the end."""
    held = docs.sparkSession.sparkContext.broadcast(
        [[r.phrase for r in t.select("phrase").distinct().toLocalIterator()] for t in tables])
    merge, strip = merged_tokens, without_groups

    def work(known):
        import pyarrow as pa

        known = [pa.array(t, pa.string()) for t in known]

        def step(part):
            tokens = part.column(1)
            for t in known:
                tokens = merge(tokens, t)
            return strip(tokens) if unmarked else tokens

        return step

    rows = docs.select(F.col(doc_col), F.col(tokens_col).alias(out))
    return _in_rows(rows, lambda: work(held.value), rows.schema)


def _in_rows(rows: DataFrame, make, schema) -> DataFrame:
    """``rows`` with ``make()(batch)`` for their second column, a list of tokens; :data:`HELD_TOKENS` at a time."""
    most, names = HELD_TOKENS, [f.name for f in schema]

    def work(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        step = make()
        for batch in batches:
            total = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                before = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, before + most, "right")))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), step(part)], names=names)
                lo = hi

    return rows.mapInArrow(work, schema)


def _like(tokens, flat):
    """A list array with the rows of ``tokens`` (null ones too) and other values."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.ListArray.from_arrays(ends, flat, mask=pc.is_null(tokens))


def with_groups(tokens, of):
    """The tokens with the number of their row's group (``of``, a struct with ``g``) before them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    mark = pc.binary_join_element_wise(pc.struct_field(of, "g").cast(pa.string()), "", GROUP_END)
    row = pc.list_parent_indices(tokens)
    return _like(tokens, pc.binary_join_element_wise(mark.take(row), tokens.flatten(), ""))


def without_groups(tokens):
    """Tokens and phrases of :func:`with_groups` as they were."""
    import pyarrow.compute as pc

    coded = tokens.flatten().dictionary_encode()
    plain = pc.replace_substring_regex(coded.dictionary, f"-?[0-9]+{GROUP_END}", "")
    return _like(tokens, plain.take(coded.indices))


def _merged_by_window(docs: DataFrame, phrases: DataFrame, doc_col: str, tokens_col: str, out: str) -> DataFrame:
    t = F.col(tokens_col)
    n = F.size(t)
    # (pos, token, next token) per position without a window: zip with the shifted array.
    nxt = F.when(n > 0, F.concat(F.slice(t, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit(None).cast("string")))) \
           .otherwise(F.array().cast("array<string>"))
    # Documents are told apart by a row number of their own: keys may repeat or be NULL.
    rid = docs.withColumn("_prow", F.monotonically_increasing_id())
    rows = rid.select("_prow", doc_col, F.posexplode_outer(F.arrays_zip(t.alias("tok"), nxt.alias("nxt"))).alias("pos", "z")) \
               .select("_prow", doc_col, "pos", "z.tok", "z.nxt")
    # Broadcast the phrase keys after a size check so the token stream keeps its
    # document partitioning (the window and regrouping below then need no
    # shuffle); above the bound the planner falls back to a shuffle join.
    ph = broadcast_if_small(phrases.select(F.col("phrase").alias("_key")).distinct())
    rows = rows.withColumn("_key", F.concat_ws(DELIM, "tok", "nxt"))
    rows = rows.join(ph.withColumn("q", F.lit(True)), "_key", "left") \
               .withColumn("q", F.coalesce("q", F.lit(False)) & F.col("nxt").isNotNull())
    w = Window.partitionBy("_prow", doc_col).orderBy("pos")
    start = F.max(F.when(~F.col("q"), F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    picked = F.col("q") & (((F.col("pos") - F.coalesce(start, F.lit(-1)) - 1) % 2) == 0)
    rows = rows.withColumn("picked", picked)
    rows = rows.withColumn("prev_picked", F.coalesce(F.lag("picked").over(w), F.lit(False)))
    emitted = (rows.filter(~F.col("prev_picked"))
               .select("_prow", doc_col, "pos", F.when(F.col("picked"), F.col("_key")).otherwise(F.col("tok")).alias("w")))
    kept = F.filter(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"].isNotNull())
    return emitted.groupBy("_prow", doc_col).agg(F.transform(kept, lambda s: s["w"]).alias(out)).drop("_prow")


def learn_and_merge(docs: DataFrame, doc_col: str, tokens_col: str = "tokens", min_count: int = 5,
                    threshold: float = 10.0, second_min_count: int = 5,
                    order: str = "reference", grouped: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C6 + C7: two phrase passes.

    Pass 1 learns on the tokens; pass 2 learns on pass-1-merged tokens (its
    min_count is always the library default 5, as in the reference). With
    ``order='reference'`` the final transform applies pass 2 first and then
    pass 1 to the raw tokens (so three-word phrases rarely arise);
    ``order='bigram_first'`` applies pass 1, then pass 2. With ``grouped`` tokens carry their group's
    number (see :func:`learn_phrases`), which the merged ones do not.
    Returns (merged docs, pass-1 table, pass-2 table). The copy of ``docs`` that the merged ones read may be
    :func:`release`d through them once they are written.
    """
    docs = materialize(docs.select(doc_col, tokens_col))
    p1 = learn_phrases(docs, tokens_col, min_count, threshold, grouped)
    m1 = materialize(merge_phrases(docs, p1, doc_col, tokens_col, "_m1"))
    p2 = learn_phrases(m1.select(doc_col, F.col("_m1").alias("_t")), "_t", second_min_count, threshold, grouped)
    if order == "reference":
        start, tables, column = docs, [p2, p1], tokens_col
    elif order == "bigram_first":
        start, tables, column = m1, [p2], "_m1"
    else:
        raise ValueError("order must be 'reference' or 'bigram_first'")
    if start is docs:
        release(m1)
    if max(map(_held_bytes, tables)) <= HELD_BYTES // len(tables):
        res = _merged_in_rows(start, tables, doc_col, column, "phrased", grouped)
        res._kept = start._kept  # what it reads, for who has written it
        return res, p1, p2
    res = start
    for t in tables:
        res, column = merge_phrases(res, t, doc_col, column, "_m3"), "_m3"
    if grouped:
        res = res.withColumn("_m3", F.transform("_m3", lambda t: F.regexp_replace(t, f"-?[0-9]+{GROUP_END}", "")))
    return res.withColumnRenamed("_m3", "phrased"), p1, p2


def phrases_in_groups(docs: DataFrame, min_count: int = 5, threshold: float = 10.0) -> DataFrame:
    """:func:`learn_and_merge` for every group of ``g, doc, tokens`` rows (``g`` a long) in one
    set of jobs: a token carries its group's number, so no key is shared between groups."""
    mark = with_groups
    rows = docs.select(F.struct(F.col("g").cast("long").alias("g"), "doc").alias("_of"), F.col("tokens").cast("array<string>").alias("tokens"))
    marked = _in_rows(rows, lambda: lambda part: mark(part.column(1), part.column(0)), rows.schema)
    merged, _, _ = learn_and_merge(marked, "_of", "tokens", min_count, threshold, grouped=True)
    out = merged.select("_of.g", "_of.doc", F.col("phrased").alias("tokens"))
    out._kept = getattr(merged, "_kept", None)
    return out
