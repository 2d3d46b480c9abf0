"""Operator 12: against a dictionary of prefixes, with shards of every size."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from threadlens.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, group=5, modulus=9):
    """Conversations spliced as in the contract: {conv_id: ((role, text), ...)}; % as in SQL."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in by.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % modulus
        out[c] = tuple(turns.get(c - int(math.fmod(c, group)), [])[:h] + own[h:])
    return out


def brute(convs):
    """Rows of the trie, straight from its definition."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, cs in members.items():
        own = (len(cs) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += own
    out = set()
    for path, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(path))))
        out.add((min(cs), len(path), min(members[path[:-1]]) if path else None, len(cs), kids[path], leaves[path],
                 saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def got_of(df):
    rows = [tuple(r[c] for c in T.NODE) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(n, seed, texts=4, deep=12):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        kind = rnd.random()
        for t in range(6 if kind < .4 else rnd.randint(0, deep)):
            text = "same" if kind < .4 else rnd.choice(["a", "b", "é🙂", "", None, "long " * 9][:texts + 2])
            rows.append((c * (3 if c % 7 else 1) - 5, t, rnd.choice(["user", "bot", None]) if kind > .8 else "user", text))
    return rows


@pytest.mark.parametrize("cells,rows_a_shard,piece,width", [(1 << 21, 1 << 16, 4096, 3), (40, 7, 10, 4), (1, 1, 1, 5)])
def test_equals_brute_force(spark, monkeypatch, cells, rows_a_shard, piece, width):
    monkeypatch.setattr(T, "CELLS", cells)
    monkeypatch.setattr(T, "ROWS", rows_a_shard)
    monkeypatch.setattr(T, "PIECE", piece)
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        rows = random_rows(120, seed=cells)
        # One long conversation, and its copy in the trie up to the last turn.
        rows += [(9000 + i, t, "u", f"t{t}") for i in range(2) for t in range(90 + i)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        assert got_of(T.nodes(T.splice(T.sequences(df, group=5)))) == brute(rebuilt(rows))
        plain = {c: t for c, t in rebuilt(rows, modulus=1).items()}  # nothing is spliced
        assert got_of(T.nodes(T.sequences(df))) == brute(plain)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_awkward_rows(spark):
    rows = [(0, None, "user", "first"), (0, 1, None, None), (0, 1, None, None), (0, 2, "", ""), (1, 0, "user", "first"),
            (None, 0, "user", "nobody"), (2, 5, "user", "x" * 200_000), (7, 0, "u", "lost base"), (-3, 0, "u", "minus"),
            (10, 3, "b", "tie"), (10, 3, "a", "tie"), (10, 3, "a", "tie")]
    df = spark.createDataFrame([(*r, 1, b"k", 2) for r in rows], SCHEMA + ", depth int, key binary, part int")
    assert got_of(T.nodes(T.splice(T.sequences(df, group=5)))) == brute(rebuilt(rows))
    # The id of a base is conv_id - conv_id % group as in SQL, so -3 goes with 0.
    found = {r.conv_id: r.base for r in T.sequences(df, group=5).collect()}
    assert found[-3] == 0 and found[7] == 5 and None not in found
    assert got_of(T.nodes(T.sequences(df.limit(0)))) == set()


def test_conversations_without_turns_are_members_of_the_root(spark):
    # crc32("3") % 9 turns of an absent base and none of its own.
    c = next(c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    df = spark.createDataFrame([(c, 0, "user", "gone"), (1000, 0, "user", "here")], SCHEMA)
    want = brute(rebuilt([(c, 0, "user", "gone"), (1000, 0, "user", "here")]))
    assert got_of(T.nodes(T.splice(T.sequences(df, group=5)))) == want
    assert any(n[0] == c and n[1] == 0 and n[3] == 2 for n in want)


def test_hashes_run_over_pieces(spark):
    ids = [*range(0, 3000, 3)]
    pieces = [(bytearray(k), 0, 0, n, p) for k in (b"a", b"b") for n, p in enumerate(T.list_pieces(ids))]
    assert len(pieces) > 2
    df = spark.createDataFrame(pieces, "key binary, part int, seq int, num long, ids string")
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {bytes(r.key): r.ends_sha256 for r in T.list_hashes(df).collect()} == {b"a": want, b"b": want}
