"""Display helpers (A11 currency, A12 month-year, A19 KPI text)."""

from decimal import Decimal

from conftest import D
from tierscope.operators import report


def test_currency_rounds_half_even_like_python_decimals(spark):
    vals = [Decimal("1234.50"), Decimal("1235.50"), Decimal("1234567.89"), Decimal("-2.50"),
            Decimal("0.00")]
    df = spark.createDataFrame([(v,) for v in vals], "x decimal(18,2)")
    got = [r.t for r in df.select(report.currency_text("x", 0).alias("t")).collect()]
    assert got == ["$" + format(v, ",.0f") for v in vals]
    got2 = [r.t for r in df.select(report.currency_text("x", 2).alias("t")).collect()]
    assert got2 == ["$" + format(v, ",.2f") for v in vals]


def test_month_year_and_counts(spark):
    df = spark.createDataFrame([(D("2023-03-31"), 1234567)], "d date, n long")
    r = df.select(report.month_year("d").alias("m"), report.count_text("n").alias("c")).first()
    assert (r.m, r.c) == ("Mar 2023", "1,234,567")


def test_signed_pct_text(spark):
    df = spark.createDataFrame([(3.21,), (-0.44,), (0.0,)], "x double")
    got = [r.t for r in df.select(report.signed_pct_text("x").alias("t")).collect()]
    assert got == ["+3.2% MoM", "-0.4% MoM", "+0.0% MoM"]
