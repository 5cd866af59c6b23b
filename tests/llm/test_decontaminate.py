"""Suffix-automaton decontamination against brute force over all windows."""

import random
import re

import pytest

from oracle_compare import compare, duck
from tierscope.llm import decontaminate as d
from tierscope.llm.oracle import SQL
from tierscope.llm.queries import op1_benchmark_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "items string, text string, doc_id bigint, n_chars bigint"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text, bench, window):
    own = WORD.findall(lower(text))
    hit, items = set(), set()
    for item, t in bench:
        w = WORD.findall(lower(t))
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            for j in range(len(own) - k + 1):
                if own[j:j + k] == w[i:i + k]:
                    hit |= set(range(j, j + k))
                    items.add(item)
    return len(own), hit, sorted(i for i in items if i is not None)


@pytest.mark.parametrize("shard_words", [1_000_000, 25])
def test_scan_equals_brute_force(spark, shard_words):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("ab é C") for _ in range(n))
    bench = [(i, text(rng.randint(0, 14))) for i in range(12)] + [(3, None), (None, "a b a b"), (20, "."), (20, "c c c c c")]
    docs = [("x", None if i == 0 else "" if i == 1 else text(rng.randint(0, 80)), i // 2, 1) for i in range(40)]
    out = d.scan(spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id bigint, text string"),
                 window=5, shard_words=shard_words)
    got = sorted((r.doc_id, r.text or "", r.n_words, r.n_hit, tuple(r["items"])) for r in out.collect())
    want = []
    for _, t, i, _ in docs:
        n, hit, items = brute(t, bench, 5)
        want.append((i, t or "", n, len(hit), tuple(items)))
    assert got == sorted(want)


def test_shards_are_bounded_whatever_repeats(spark, monkeypatch):
    """40 equal items are one, a huge item is a shard of its own, and no shard has more
    than the bound and one item."""
    made = []
    real = d._packed
    monkeypatch.setattr(d, "_packed", lambda items: made.append(sum(len(w) for _, w in items)) or real(items))
    huge = " ".join(f"h{k}" for k in range(500))
    bench = [(1, "a b c d e f g")] * 40 + [(2, huge)] + [(i, f"x{i} y{i} z{i}") for i in range(3, 60)]
    docs = spark.createDataFrame([("s", "a b c d e f g " + huge, 1, 1), ("s", "x9 y9 z9", 2, 1)], DOCS)
    out = {r.doc_id: (r.n_hit, r["items"]) for r in d.scan(
        docs, spark.createDataFrame(bench, "item_id bigint, text string"), window=5, shard_words=60).collect()}
    assert out == {1: (507, [1, 2]), 2: (3, [9])}
    assert sum(made) == 7 + 500 + 57 * 3 and len(made) <= 13 and sorted(made)[-2] <= 63


def test_many_shards_are_one_pass(spark, monkeypatch):
    """Any number of shards is one Python step over the documents, cut into chunks or not."""
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    bench = [(i, text(rng.randint(3, 12))) for i in range(60)]
    docs = [("s", text(rng.randint(0, 60)), i, 1) for i in range(30)] + [("s", text(400), 30, 1), ("s", None, 31, 1)]
    df, items = spark.createDataFrame(docs, DOCS).coalesce(1), spark.createDataFrame(bench, "item_id bigint, text string")
    found = []
    for shard_words, chunk in ((10_000, 1 << 20), (10, 1 << 20), (10, 100)):
        monkeypatch.setattr(d, "CHUNK_BYTES", chunk)
        out = d.scan(df, items, window=5, shard_words=shard_words)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        found.append(sorted((r.doc_id, r.n_hit, tuple(r["items"]), r.longest, r.kept_text or "") for r in out.collect()))
    assert found[0] == found[1] == found[2]
    assert [(i, n, ids) for i, n, ids, _, _ in found[0]] == [
        (i, len(hit), tuple(own)) for _, t, i, _ in docs for _, hit, own in [brute(t, bench, 5)]]


def test_cut_and_coverage(spark):
    passage = "One two three four five six seven eight nine ten."
    bench = spark.createDataFrame([(1, passage)], "item_id bigint, text string")
    long = "Before, " + "clean words here " * 20 + passage + " After."
    docs = spark.createDataFrame([("s", long, 1, len(long)), ("s", passage, 2, 5), ("s", "all clean", 3, 99),
                                  ("s", None, 4, None)], DOCS)
    out = {r.doc_id: r for r in d.decontaminate(docs, bench).collect()}
    assert set(out) == {1, 3, 4}
    assert "four" not in out[1].text and out[1].text.endswith(". After.") and out[1].n_chars == len(out[1].text)
    assert (out[3].text, out[3].n_chars, out[4].text) == ("all clean", 99, None)
    empty = d.decontaminate(docs.where("false"), bench)
    assert empty.columns == docs.columns and empty.count() == 0
    assert d.decontaminate(docs, bench.where("false")).count() == 4


def test_oracle(spark):
    sf = "/root/testdata/sf0.001"
    name = "op1_benchmark_decontamination"
    got = compare(op1_benchmark_decontamination(spark, sf), duck(sf), SQL[name])
    assert got["ok"], got
