"""The prefix trie next to dictionaries of prefixes."""

import hashlib
import random
import zlib

import pytest

from loginlake.llm import prefix_trie
from loginlake.llm.common import Store

SCHEMA = "conv_id bigint, turn int, role string, text string, n_convs string, block int, p double"


def conversations():
    rng = random.Random(23)
    rows = []
    for c in [*range(0, 24), *range(98, 131), 200, 207, 300, 999, -5, -100, -101, -230, 10**12 + 7]:
        n = rng.choice([0, 1, 1, 2, 3, 5, 8, 9, 16, 17, 40])
        base = rng.randrange(3)
        for t in range(n):
            text = ["", "é漢", "hello there", None][(t + base) % 4] if t < 30 else f"own {c % 2} {t}"
            rows.append((c, t if rng.random() < 0.9 else rng.choice([None, 1]), rng.choice([None, "user"]) if t > 6 else "user", text))
    # texts and roles that would be equal if they were only joined
    rows += [(400, 0, "a", "bc"), (401, 0, "ab", "c"), (402, 0, "", "abc"), (403, 0, "3:a", "bc")]
    rows += [(c, t, "user", f"copy {t}") for c in range(500, 540) for t in range(20)] * 1
    rows += [(541, 1, "user", "twice")] * 3 + [(None, 0, "user", "of no conversation")] * 2
    rng.shuffle(rows)
    return rows


def plain_version(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [(r, x) for *_, r, x in sorted(found)] for c, found in turns.items()}
    paths = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = tuple(turns.get(c - int(abs(c) % 100) * (1 if c >= 0 else -1), [])[:h] + own[h:])
    members = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members.setdefault(paths[c][:d], []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
        leaves[node] = leaves.get(node, 0) or 1
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        if node:
            leaves[node[:-1]] = leaves.get(node[:-1], 0) + leaves[node]
            saved[node[:-1]] = saved.get(node[:-1], 0) + saved[node]
    out = []
    for node, of in members.items():
        ends = ",".join(str(c) for c in of if len(paths[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((of[0], len(node), parent, len(of), children.get(node, 0), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize(("block", "chunk", "bits"), [(8, 1 << 16, 12), (1, 3, 0), (3, 2, 2)])
def test_plain_version(spark, block, chunk, bits):
    rows = conversations()
    table = spark.createDataFrame([(*r, "x", 1, 0.5) for r in rows], SCHEMA).repartition(7)
    store = Store(spark, "trie-test")
    got = prefix_trie.trie(prefix_trie.rebuilt(table, store), store, block, chunk, bits).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0])) == plain_version(rows)


def test_hot_conversation_lies_in_many_parts(spark):
    """One conversation with nearly all turns is sorted and numbered by many tasks."""
    rows = [(7, t, "user", f"turn {t % 11}") for t in range(4000)] + [(c, 0, "user", "x") for c in range(10, 30)]
    store = Store(spark, "trie-test")
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _, runs = prefix_trie.ordered(table, store)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = [r.n for r in runs.where("conv_id = 7").collect()]
    assert len(hot) >= 4 and max(hot) < 2000
    got = prefix_trie.trie(prefix_trie.rebuilt(table, store), store, chunk=16).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0])) == plain_version(rows)


def test_pieces_follow_each_other(spark):
    """The hash of a node with many pieces is that of all its ids, negative ones first."""
    rows = [(c, 0, "user", "same") for c in range(-3000, 9000, 3) if zlib.crc32(str(c).encode()) % 6 == 0]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        store = Store(spark, "trie-test")
        got = prefix_trie.trie(prefix_trie.rebuilt(table, store), store, piece_bits=4).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((tuple(r) for r in got), key=lambda r: (r[1], r[0])) == plain_version(rows)


def test_empty(spark):
    table = spark.createDataFrame([], "conv_id bigint, turn int, role string, text string")
    store = Store(spark, "trie-test")
    assert prefix_trie.trie(prefix_trie.rebuilt(table, store), store).count() == 0
