"""The trie against a brute force over all prefixes, for every number of shards."""

import hashlib
import random
import zlib

import pytest

from tierscope.llm import prefix_trie as pt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string"


def brute(rows):
    convs = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append((c, d == len(path)))
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[:len(p)] == p]
        ids = sorted(c for c, _ in members)
        out.add((ids[0], len(p), min(c for c, _ in nodes[p[:-1]]) if p else None, len(ids),
                 sum(len(q) == len(p) + 1 for q in below),
                 sum(not any(r[:-1] == q and r for r in below) for q in below),
                 sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q),
                 hashlib.sha256(",".join(str(c) for c in sorted(c for c, e in members if e)).encode()).hexdigest()))
    return out


def rows_of(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for t in range(rng.choice([1, 2, 2, 4, 9])):
            rows.append((c * rng.choice([1, 1, 50]), t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "𝒳"]), "x"))
    return rows


@pytest.mark.parametrize("shards", [1, 2, 7, 40])
def test_equals_brute_force(spark, shards):
    rows = rows_of(shards)
    found = pt.trie(pt.rebuild(spark.createDataFrame(rows, SCHEMA)), shards)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_edge_rows(spark):
    long = "é" * 60_000
    rows = [(1, 0, None, None, "x"), (1, None, "user", long, "x"), (1, 0, None, None, "x"), (2, 0, "user", "a", "x"),
            (None, 0, "user", "a", "x"), (100, 0, "user", "a", "x"), (100, 1, "user", "b", "x"),
            (101, 0, "user", "a", "x"), (102, 5, "user", "z", "x"), (7, None, None, None, "x")]
    rows += [(200 + k, t, "user", "same", "x") for k in range(30) for t in range(k % 3 + 1)]
    for shards in (1, 3, 9):
        got = [tuple(r) for r in pt.trie(pt.rebuild(spark.createDataFrame(rows, SCHEMA)), shards).collect()]
        assert set(got) == brute(rows) and len(got) == len(set(got))
    assert pt.trie(pt.rebuild(spark.createDataFrame(rows, SCHEMA).where("false"))).count() == 0


def test_one_long_conversation(spark):
    rows = [(5, t, "user", str(t), "x") for t in range(120)] + [(6, t, "user", str(t), "x") for t in range(8)]
    assert {tuple(r) for r in pt.trie(pt.rebuild(spark.createDataFrame(rows, SCHEMA)), 3).collect()} == brute(rows)


def test_tree_is_balanced_and_keeps_sequences():
    tree, n = pt.TernaryTree(), 1023
    ends = {i: tree.insert([i]) for i in pt.medians(n)}
    assert sorted(ends) == list(range(n)) and len(set(ends.values())) == n
    assert [v for v in ends.values()] == [tree.insert([i]) for i in ends]
    depth, stack = 0, [(tree.top, 1)]
    while stack:
        node, d = stack.pop()
        if node >= 0:
            depth = max(depth, d)
            stack += [(tree.less[node], d + 1), (tree.more[node], d + 1)]
    assert depth == 10
    assert tree.insert([]) == 0
