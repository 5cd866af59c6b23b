"""Binary codes: unbiased estimates, certain bounds, and exact links."""

import numpy as np
import pytest

from tierscope.llm import binary_codes as b

SCHEMA = "links string, embedding array<float>, label int, vec_id bigint"


def test_estimates_and_bound():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 32))
    y = x + 0.15 * rng.standard_normal(x.shape)
    ux, uy = (v / np.linalg.norm(v, axis=1)[:, None] for v in (x, y))
    cos = (ux * uy).sum(1)
    errors = []
    for seed in range(40):
        turn = b.rotation(32, seed)
        codes, f = b.encode(ux, turn)
        est = b.estimate(codes, f, uy @ turn.T).diagonal()
        errors.append(est - cos)
        near = cos >= 0.98
        assert near.any() and (est[near] >= b.bound(f, 0.98, 1.0)[near]).all()
    assert abs(np.mean(errors)) < 2e-3


@pytest.mark.parametrize("block", [2048, 7])
def test_equals_brute_force(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    vectors = [base[i % 12] + 0.05 * rng.standard_normal(16) * (i % 5) for i in range(90)]
    rows = [("x", [float(np.float32(c)) for c in v], i % 3, i) for i, v in enumerate(vectors)]
    rows += [("x", rows[0][1], 0, 90), ("x", rows[0][1], 0, 91), ("x", rows[0][1], None, 92), ("x", None, 0, 93),
             ("x", [0.0] * 16, 0, 94), ("x", [0.0] * 16, 0, 95), ("x", [float("nan")] + [1.0] * 15, 0, 96),
             ("x", [None] + [1.0] * 15, 0, 97), ("x", [float("inf")] * 16, 0, 98), ("x", [1.0, 2.0], 0, 99),
             ("x", [2.0, 4.0], 0, 100), ("x", [], 0, 101), ("x", [], 0, 102)]
    ok = [r for r in rows if r[1] and r[2] is not None and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1])]
    link = {r[3]: set() for r in rows}
    for p in ok:
        for q in ok:
            if p[3] != q[3] and p[2] == q[2] and len(p[1]) == len(q[1]):
                v, w = np.array(p[1]), np.array(q[1])
                if v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                    link[p[3]].add(q[3])
    want = set()
    for i in link:
        reach, todo = {i}, [i]
        while todo:
            todo += (new := link[todo.pop()] - reach)
            reach |= new
        want.add((i, len(link[i]), min(reach), min(reach) == i))
    out = b.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block)
    assert {tuple(r) for r in out.collect()} == want


def test_null_and_repeated_ids(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([("x", v, 1, None), ("x", v, 1, 4), ("x", v, 1, 4), ("x", v, 1, 7)], SCHEMA)
    got = [tuple(r) for r in b.near_duplicates(df).collect()]
    assert len(got) == 4
    assert set(got) == {(None, 0, None, False), (4, 2, 4, True), (7, 2, 4, False)}
    assert b.near_duplicates(df.where("false")).count() == 0
