"""The distributed exact median equals numpy's median (= percentile_cont)."""

import random

import numpy as np

from tierscope.operators.quantile import exact_median


def test_exact_median_matches_numpy(spark):
    rnd = random.Random(3)
    rows = []
    groups = {"a": [rnd.randint(0, 50) for _ in range(501)],            # many ties, odd n
              "b": [rnd.randint(-10**15, 10**15) for _ in range(400)],  # wide, negative, even n
              None: [rnd.choice([0, 0, 0, 7, 2**40 + 3]) for _ in range(10)],
              "c": [5], "d": [-(2**62), 2**62]}
    for g, vals in groups.items():
        rows += [(g, x) for x in vals]
    rows += [("a", None), ("e", None)]                                # NULLs ignored
    df = spark.createDataFrame(rows, "g string, v long")
    got = {r.g: r.median for r in exact_median(df, "g", "v").collect()}
    want = {g: float(np.median(np.array(vals, dtype=object).astype(float)))
            if g != "b" else None for g, vals in groups.items()}
    # group b: exact mean of the two middle integers (beyond double precision
    # of numpy's float path), computed in Python integers
    b = sorted(groups["b"])
    want["b"] = (b[199] + b[200]) / 2
    want["d"] = 0.0
    assert set(got) == set(groups)                                    # "e" has no value
    for g in groups:
        assert got[g] == want[g], g
