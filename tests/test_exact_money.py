"""Money and sums are exact over the whole of DECIMAL(18,2), with ANSI on or off."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import row, table
from tierscope.functions.expr import cents, exact_sum, from_cents
from tierscope.operators import revenue

TOP = "9999999999999999.99"


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def test_cents_at_both_extremes(spark, ansi):
    values = [TOP, f"-{TOP}", "900719925474099.37", "-0.01", "0.00"]
    df = spark.createDataFrame([(Decimal(v),) for v in values], "m decimal(18,2)")
    got = [r[0] for r in df.select(cents("m")).collect()]
    assert got == [int(Decimal(v) * 100) for v in values]
    back = [r[0] for r in df.select(from_cents(cents("m"))).collect()]
    assert back == [float(Decimal(v)) for v in values]


def test_sums_beyond_bigint(spark, ansi):
    values = [2 ** 63 - 1, 2 ** 63 - 1, -2 ** 63, 2 ** 62, -1, 0, None]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert int(df.agg(exact_sum("v")).first()[0]) == sum(v for v in values if v is not None)
    assert df.where("v is null").agg(exact_sum("v")).first()[0] is None


def test_totals_keep_their_cents(spark, ansi):
    t = table(spark, [row(1, "2023-01-31", arr="90071992547409.93"), row(2, "2023-01-31", arr="-90071992547409.00"),
                      *[row(10 + i, "2023-02-28", arr=TOP) for i in range(300)]])
    totals = [r.total_arr for r in revenue.arr_by_plan(t).orderBy("month_date").collect()]
    assert totals == [0.93, float(Decimal(TOP) * 300)]
    assert [r.total_arr for r in revenue.monthly_metrics(t).orderBy(F.col("month_date")).collect()] == totals
