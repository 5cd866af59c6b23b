"""Connected components against union-find."""

import random

import pytest

from tierscope.llm.common import connected_components


@pytest.mark.parametrize("shape", ["random", "path", "star"])
def test_components(spark, shape):
    rng = random.Random(6)
    edges = {"random": [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)],
             "path": [(i, i + 1) for i in range(40)] + [(90, 91)],
             "star": [(50, i) for i in range(120) if i != 50] + [(200, 201), (201, 200), (7, 7)]}[shape]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([*edges, (None, 3), (5, None)], "a bigint, b bigint")
    assert {tuple(r) for r in connected_components(df).collect()} == {(x, find(x)) for x in list(root)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
