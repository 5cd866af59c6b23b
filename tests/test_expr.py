import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from conftest import D
from tierscope.functions.expr import plan_rank, round_div, whole_months, years_from_months


def _half_up(num, den, scale):
    q = Decimal(num) / Decimal(den)
    return float(q.quantize(Decimal(1).scaleb(-scale), rounding=ROUND_HALF_UP))


def test_round_div_matches_decimal_half_up(spark):
    rnd = random.Random(7)
    cases = [(5, 2, 0), (-5, 2, 0), (1, 3, 2), (2, 3, 2), (1, 8, 2), (-1, 8, 2), (0, 5, 1),
             (10**15 + 1, 2, 0), (3, 12, 1), (-3, 12, 1)]
    cases += [(rnd.randint(-10**12, 10**12), rnd.randint(1, 10**6), rnd.randint(0, 3))
              for _ in range(200)]
    df = spark.createDataFrame(cases, "num long, den long, scale int")
    got = {}
    for s in (0, 1, 2, 3):
        for r in (df.filter(F.col("scale") == s)
                  .select("num", "den", round_div(F.col("num"), F.col("den"), s).alias("r"))
                  .collect()):
            got[(r.num, r.den, s)] = r.r
    for num, den, s in cases:
        assert got[(num, den, s)] == _half_up(num, den, s), (num, den, s)


def test_round_div_money_tie_and_zero_denominator(spark):
    df = spark.createDataFrame([(Decimal("4269057.56"), 8), (Decimal("1.00"), 0)],
                               "s decimal(28,2), n long")
    out = df.select(round_div("s", "n", 2).alias("r")).collect()
    assert out[0].r == 533632.20   # exact tie 533632.195 rounds half up
    assert out[1].r is None        # NULLIF(den, 0)


def test_whole_months_follows_age_not_months_between(spark):
    cases = [("2023-03-31", "2023-01-31", 2), ("2023-02-28", "2023-01-31", 0),
             ("2023-03-30", "2023-01-31", 1), ("2023-03-31", "2023-03-31", 0),
             ("2020-01-01", "2020-04-01", -3), ("2020-01-31", "2020-04-01", -2),
             ("2024-02-29", "2023-02-28", 12), ("2023-05-15", "2021-06-16", 22)]
    df = spark.createDataFrame([(D(a), D(b)) for a, b, _ in cases], "a date, b date")
    got = [r.m for r in df.select(whole_months("a", "b").alias("m")).collect()]
    assert got == [c[2] for c in cases]
    nulls = spark.createDataFrame([(D("2023-01-31"), None), (None, D("2023-01-31"))],
                                  "a date, b date")
    assert [r.m for r in nulls.select(whole_months("a", "b").alias("m")).collect()] == [None, None]
    # months_between treats two month-ends as a whole month; AGE does not
    mb = df.select(F.floor(F.months_between("a", "b")).alias("m")).collect()[1].m
    assert mb == 1 and got[1] == 0


def test_years_from_months_half_away_from_zero(spark):
    df = spark.createDataFrame([(m,) for m in (3, -3, 18, 1, 7, 0, 9)], "m int")
    got = [r.y for r in df.select(years_from_months("m").alias("y")).collect()]
    assert got == [0.3, -0.3, 1.5, 0.1, 0.6, 0.0, 0.8]


def test_plan_rank(spark):
    df = spark.createDataFrame([(p,) for p in ("Free", "Trial", "Low", "Middle", "Top",
                                               None, "Enterprise")], "plan string")
    assert [r.r for r in df.select(plan_rank().alias("r")).collect()] == [1, 2, 3, 4, 5,
                                                                          None, None]
