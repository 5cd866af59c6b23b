"""N-gram Jaccard join against brute force over all pairs."""

import random

import numpy as np
import pytest

from tierscope.llm import ngram_join as j

SCHEMA = "component string, text string, doc_id bigint, n_chars bigint"


def brute_sets(text, size=5):
    own = (text or "").encode().translate(j._LOWER).split()
    k = min(size, len(own))
    return {tuple(own[i:i + k]) for i in range(len(own) - k + 1)} if own else set()


def brute(rows):
    sets = {i: brute_sets(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    m = min(comp[a], comp[b])
                    changed |= comp[a] != m or comp[b] != m
                    comp[a] = comp[b] = m
    return {(i, len(sets[i]), comp[i]) for i in sets}


def texts(rng):
    out = []
    for n in (3, 5, 8, 40, 120, 400):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(n)]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, max(1, n // 25))):
                own[rng.randrange(n)] = f"v{rng.randint(0, 9)}"
            out.append(" ".join(own[rng.randint(0, n // 10):]))
    passage = " ".join(f"p{k}" for k in range(60))
    out += [passage + " " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 80))) for _ in range(40)]
    return out + [None, "", " \n\t", "One TWO", "one two", "a b c d", "a b c d e", out[0], out[0], "É b c d e", "é b c d e"]


@pytest.mark.parametrize("block, column_rows", [(512, j.COLUMN_ROWS), (4, j.COLUMN_ROWS), (4, 3)])
def test_equals_brute_force(spark, block, column_rows):
    rows = list(enumerate(texts(random.Random(12))))
    docs = spark.createDataFrame([("c", t, i, 1) for i, t in rows], SCHEMA).repartition(3)
    assert {tuple(r) for r in j.join(docs, block=block, column_rows=column_rows).collect()} == brute(rows)


@pytest.mark.parametrize("column_rows", [j.COLUMN_ROWS, 20])
def test_hot_passage_and_copies(spark, column_rows):
    """A passage in every text, and a third of all rows equal: nothing is lost, in
    whole columns and in split ones."""
    rng = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(30))
    rows = [(i, passage + " x" if i % 3 == 0 else passage + " " + " ".join(f"r{rng.randint(0, 10**6)}" for _ in range(90)))
            for i in range(150)]
    docs = spark.createDataFrame([("c", t, i, 1) for i, t in rows], SCHEMA)
    assert {tuple(r) for r in j.join(docs, column_rows=column_rows).collect()} == brute(rows)


def test_keep_one(spark):
    rows = [("c", "a b c d e f", 5, 1), ("c", "A b c d e f", 3, 2), ("c", "other words stand here now", 9, 3),
            ("c", None, 10, None), ("c", "a b c d e f", None, 4), ("c", "other words stand here now", 9, 3)]
    out = j.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["component", "text", "doc_id", "n_chars"]
    assert sorted(repr(r.doc_id) for r in out.collect()) == ["10", "3", "9", "None"]
    nothing = spark.createDataFrame([], SCHEMA)
    assert j.join(nothing).count() == 0 and j.keep_one(nothing).count() == 0


def test_keep_one_with_clashing_ids(spark):
    """Rows that share an id but not a text are two documents; the choice is the same
    however the rows are dealt."""
    a, b = "these are some words of one text", "nothing of it stands in this other text"
    rows = [("x", a, 1, 1), ("x", b, 1, 2), ("x", a + " again", 2, 3), ("y", b, 7, 4), ("z", b, 7, 5), ("x", "", 1, 6), ("w", None, 1, 7)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in j.keep_one(docs).collect()}
    assert {(r[2], r[1]) for r in want} == {(1, a), (1, b), (2, a + " again"), (1, ""), (1, None)}
    assert len(want) == 5 and {tuple(r) for r in j.keep_one(docs.repartition(5)).collect()} == want


def test_sketch_bound_has_room():
    """Binomial tail: a link at exactly 0.8 misses the bound less than once in 10^7."""
    from math import comb
    miss = sum(comb(j.BITS, k) * 0.9 ** k * 0.1 ** (j.BITS - k) for k in range(j.AGREE))
    assert miss < 1e-7, miss


def test_empty_tables_and_edge_rows(spark):
    """No rows give no rows; null ids have no component; texts without words link with
    nothing; a very long text and its copy link."""
    empty = spark.createDataFrame([], SCHEMA)
    assert j.join(empty).count() == 0 and j.keep_one(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(200_000))
    rows = [("x", None, 1, 0), ("x", "", 2, 0), ("x", " \t\n", 3, 0), ("x", "a b", None, 0), ("x", "A b", 4, 0),
            ("x", "a B", 9, 0), ("x", long, 7, 0), ("x", long + " end", 6, 0)]
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in j.join(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (4, 1, 4), (9, 1, 4), (7, 199_996, 6), (6, 199_997, 6)}


def test_shingles_equal_brute_force():
    """Equal shingle sets have equal hashes, different ones don't: any bytes, words of all
    lengths, texts of few words, whatever texts are hashed together."""
    rng = random.Random(3)
    raws = [bytes(rng.choice(b"abC \n\x00\x1c\xff") for _ in range(rng.randint(0, 90))) for _ in range(1500)]
    raws += [None, b"", b" \n", b"a", b"a b", b"A b", b"b a", b"a\x0bb\x0cc\rd\te", b"a b c d e f", b"a" * 8, b"a" * 9]
    raws += [b"a" * n + b" " + b"b" * m for n in (7, 8, 9, 63, 64, 65, 200) for m in (1, 8, 63, 64, 65)]

    def brute_bytes(raw):
        own = (raw or b"").translate(j._LOWER).split()
        k = min(5, len(own))
        return frozenset(tuple(own[i:i + k]) for i in range(len(own) - k + 1)) if own else frozenset()

    found = list(j.shingles(raws))
    assert [len(f) for f in found] == [len(brute_bytes(r)) for r in raws]
    pairs = {(brute_bytes(r), f.tobytes()) for r, f in zip(raws, found)}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})
    assert [next(j.shingles([r])).tobytes() for r in raws] == [f.tobytes() for f in found]


def test_column_edges_equal_all_pairs():
    """In columns of 2 to 200 documents the edges connect what all pairs do."""
    rng = np.random.default_rng(5)
    gram, n, sketch = [], [], []
    for g, size in enumerate([2] * 30 + [3] * 30 + [7] * 20 + [40, 64, 65, 200, 1]):
        bases = rng.integers(0, 2, (max(1, size // 4), j.BITS), dtype=np.uint8)
        for _ in range(size):
            flip = rng.random(j.BITS) < rng.choice([0, 0.05, 0.2])
            sketch.append(np.packbits(bases[rng.integers(len(bases))] ^ flip).view(np.uint64))
            gram.append(g * 7919)
            n.append(rng.integers(80, 130))
    gram, n, sketch = np.array(gram, np.uint64), np.array(n), np.array(sketch)
    ids = rng.permutation(len(gram))

    def components(edges):
        of = {}
        root = lambda x: x if of.setdefault(x, x) == x else root(of[x])
        for a, b in edges:
            a, b = root(a), root(b)
            of[max(a, b)] = min(a, b)
        return {x: root(x) for x in list(of)}

    for g in np.unique(gram):
        own = np.flatnonzero(gram == g)
        want = [(ids[a], ids[b]) for a in own for b in own if a < b and j._agree(sketch[a], sketch[b]) >= j.AGREE
                and 100 * min(n[a], n[b]) >= 80 * max(n[a], n[b])]
        got = j._column_edges(gram[own], ids[own], n[own], sketch[own], 80)
        assert components(got) == components(want) and len(got) < len(own)
    perm = rng.permutation(len(gram))
    whole = j._column_edges(gram[perm], ids[perm], n[perm], sketch[perm], 80)
    assert {tuple(e) for e in whole} == {tuple(e) for g in np.unique(gram) for e in j._column_edges(
        *(x[gram == g] for x in (gram, ids, n, sketch)), 80)}


def test_common_passage_fills_no_column(spark, monkeypatch):
    """A passage of all texts is in no prefix of texts that have enough else, so the
    documents of a column, which are compared in pairs, don't become more with the
    table. Links are found all the same, those of texts with little else too."""
    rng = random.Random(4)
    passage = " ".join(f"p{k}" for k in range(40))
    own = [" ".join(f"r{rng.randint(0, 10**9)}" for _ in range(40)) for _ in range(400)]
    rows = list(enumerate([f"{passage} {o}" for o in own] + [f"{passage} {o} end" for o in own[:50]]
                          + [passage, f"{passage} x", f"y {passage} z"]))
    packed = []
    send = j.dealt
    monkeypatch.setattr(j, "dealt", lambda df: packed.extend(df.collect()) or send(df))
    docs = spark.createDataFrame([("c", t, i, 1) for i, t in rows], SCHEMA).repartition(3)
    got = {tuple(r) for r in j.join(docs).collect()}
    assert got == {(i, len(brute_sets(t)), i - 400 if 400 <= i < 450 else min(i, 450)) for i, t in rows}
    columns = np.concatenate([j._unpack_entries(r.payload)[0] for r in packed])
    assert np.unique(columns, return_counts=True)[1].max() <= 3
