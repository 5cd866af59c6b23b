"""Suffix-array removal of repeats against brute force over all strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tierscope.llm import suffix_dedup as s


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) > 0).sum())
        out.append((len(r), int(gone.sum()), spans, bytes(np.frombuffer(r, np.uint8)[~gone])))
    return out


def made(rng, n):
    passages = ["".join(rng.choice("abc é") for _ in range(rng.randint(20, 90))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else
                 "".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(0, 6))]
        texts.append("".join(parts))
    return texts + [None, "", "a" * 100, texts[0], "b" * 39]


@pytest.mark.parametrize("shard_bytes,hot", [(1 << 20, 1 << 20), (300, 1 << 20), (1 << 20, 2)])
def test_equals_brute_force(spark, monkeypatch, shard_bytes, hot):
    monkeypatch.setattr(s, "HOT_CONTEXTS", hot)
    texts = made(random.Random(9), 60)
    docs = spark.createDataFrame([(t, None if i == 3 else i, "x") for i, t in enumerate(texts)],
                                 "text string, doc_id bigint, runs string").repartition(4)
    rows = s.remove_repeats(docs, 40, 8, shard_bytes=shard_bytes).collect()
    got = sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    want = sorted((repr(None if i == 3 else i), *x) for i, x in enumerate(brute(texts, 40)))
    assert got == want


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(s, "_BUFFER", 300)
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh") for _ in range(2000))
    texts = [long, long[500:900] + "zz", long[::-1]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.remove_repeats(docs, 40, 8).orderBy("doc_id").collect()]
    assert got == brute(texts, 40)
    assert s.remove_repeats(docs.where("false")).count() == 0


def test_filler_is_few_runs(spark):
    """Text of a short period is one run for each piece of a text, and no task
    gathers the runs of one anchor."""
    texts = [" " * 3000, "ab" * 1500, "abc" * 900 + "x" + "abc" * 900, " " * 41 + "y", "ab" * 30, " " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = docs.selectExpr("doc_id as row", "cast(text as binary) as raw")
    found = s.find_runs(rows, 40, 8).collect()
    assert 6 <= len(found) <= 40
    starts = s.ranges(spark.createDataFrame([(r.row, r.lo, r.end) for r in found if r.whole], "row bigint, lo bigint, hi bigint"), 40)
    assert {(r.row, r.lo, r.hi) for r in starts.collect()} >= {(0, 0, 2960), (1, 0, 2960), (5, 0, 2960)}
    got = [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in s.remove_repeats(docs, 40, 8).orderBy("doc_id").collect()]
    assert got == brute(texts, 40)


def test_suffix_array_and_common_prefixes():
    rng = random.Random(1)
    for raw in [b"", b"\0\0\0", b"a" * 700, *(bytes(rng.choice(b"ab\0") for _ in range(rng.randint(1, 900))) for _ in range(30))]:
        b = np.frombuffer(raw, np.uint8)
        if not len(b):
            continue
        order, rank = s.suffix_array(b)
        want = sorted(range(len(raw)), key=lambda i: raw[i:])
        assert order.tolist() == want and rank[order].tolist() == list(range(len(raw)))
        lcp = s.common_prefixes(s.words_at(b), order, rank, 400)
        for r in range(1, len(raw)):
            x, y = raw[want[r]:], raw[want[r - 1]:]
            k = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert lcp[r] == min(k, 400)


def test_query_equals_brute_force(spark):
    from tierscope.llm.queries import op7_suffix_array_dedup
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, n, gone, spans, hashlib.sha256(kept).hexdigest())
            for r, (n, gone, spans, kept) in zip(rows, brute([r.text for r in rows], 400))}
    assert {tuple(r) for r in op7_suffix_array_dedup(spark, sf).collect()} == want


def test_common_prefixes_of_complementary_bytes():
    """The xor of the words is 2**56 - 1, which as a double has one byte more."""
    raw = b"\x01" + b"\x55" * 7 + b"\x01" + b"\xaa" * 7
    b = np.frombuffer(raw, np.uint8)
    order, rank = s.suffix_array(b)
    assert s.common_prefixes(s.words_at(b), order, rank, 400)[1] == 1


def test_common_prefixes_of_some_starts():
    """The walk covers only the starts whose strings lie in one context (F1)."""
    rng = random.Random(6)
    for _ in range(30):
        contexts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 60))) for _ in range(rng.randint(1, 6))]
        raw = b"".join([*contexts, contexts[0]])
        sizes = np.array([len(c) for c in contexts] + [len(contexts[0])])
        begin, count = np.cumsum(sizes) - sizes, sizes - 20 + 1
        starts = [i for a, n in zip(begin, count) for i in range(a, a + n)]
        b = np.frombuffer(raw, np.uint8)
        order, _ = s.suffix_array(b)
        order = order[np.isin(order, starts)]
        assert order.tolist() == sorted(starts, key=lambda i: raw[i:])
        rank = np.full(len(raw), -1)
        rank[order] = np.arange(len(order))
        lcp = s.common_prefixes(s.words_at(b), order, rank, 20, (begin, count))
        for r in range(1, len(order)):
            x, y = raw[order[r]:], raw[order[r - 1]:]
            assert lcp[r] == next((k for k in range(20) if x[k:k + 1] != y[k:k + 1]), 20)


def test_suffix_array_of_long_repeats():
    """Threefold and twofold rounds, with and without zero bytes, to the end of repeats that meet it."""
    rng = random.Random(8)
    for alphabet in (b"ab", b"ab\0", bytes(range(1, 256))):
        part = bytes(rng.choice(alphabet) for _ in range(700))
        raw = part + part[:650] + b"a" * 300 + part + part[100:]
        order, rank = s.suffix_array(np.frombuffer(raw, np.uint8))
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        assert rank[order].tolist() == list(range(len(raw)))


def test_texts_are_dealt_once(spark):
    """Both joins of the texts with their runs read one shuffle."""
    texts = made(random.Random(5), 20)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = s.remove_repeats(docs, 40, 8)
        got = sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(brute(texts, 40))
    assert "ReusedExchange" in plan
