"""One pass for the month-local reports, from the cube and from bitmaps of appends."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from test_micro_tables import MICRO
from test_scans import table_scans
from test_state import root_dir, rows, table
from tierscope.operators import cube, revenue, usage
from tierscope.plans import inspect
from tierscope.sources.base_table import load_base_table
from tierscope.state import month_bitmaps as mb

OF_MONTHS = {  # these need the scopes month and plan only
    "m01": (cube.monthly_metrics, revenue.monthly_metrics), "m02": (cube.arr_by_plan, revenue.arr_by_plan),
    "m03": (cube.plan_distribution, revenue.plan_distribution), "m10": (cube.latest_snapshot, revenue.latest_snapshot),
    "m11": (cube.mau_metrics, usage.mau_metrics), "m12": (cube.inactive_rate_current, usage.inactive_rate_current),
    "m15": (cube.usage_trends_by_plan, usage.usage_trends_by_plan)}
ALL = OF_MONTHS | {
    "m07": (lambda c: cube.breakdown_latest(c, "country"), revenue.revenue_by_geography),
    "m08": (lambda c: cube.breakdown_latest(c, "industry"), revenue.industry_breakdown)}
NAMES = ["empty", "null_order", "null_month", "null_id", "dupes", "rounding", "plans", "odd_plans"]


def assert_equal(found, base, reports):
    found = found.persist()
    for name, (mine, theirs) in reports.items():
        got, want = mine(found), theirs(base)
        assert got.columns == want.columns and rows(got) == rows(want), name
    found.unpersist()


@pytest.mark.parametrize("name", [n for n in NAMES if n in MICRO])
def test_micro_tables(spark, name):
    base = table(spark, MICRO[name])
    assert_equal(cube.month_cube(base), base, ALL)


def test_one_scan_and_equal_reports(spark):
    base = load_base_table(spark, SF001)
    found = cube.month_cube(base)
    # the final and the initial plan, each with one scan of the table
    assert len(table_scans(inspect.executed_plan(found))) == 2
    assert_equal(found, base, ALL)
    every = cube.month_cube(base, all_months=True)
    assert_equal(every, base, {k: ALL[k] for k in ("m07", "m08", "m10")})
    assert every.where("scope = 'country'").select("month_date").distinct().count() > 1


def test_bitmaps_after_three_appends_and_a_late_file(spark):
    base = load_base_table(spark, SF001)
    months = sorted(r[0] for r in base.select("month_date").distinct().collect())
    early, late = base.where(F.col("month_date") < months[20]), base.where(F.col("month_date") >= months[20])
    # the second append adds to months that the first has, some customers a second time
    again = early.where(F.col("month_date") == months[5])
    root = root_dir("bitmaps")
    mb.append(spark, root, early, "one")
    mb.append(spark, root, late, "two")
    mb.append(spark, root, again, "three")
    whole = early.unionByName(late).unionByName(again)
    assert_equal(mb.as_cube(spark, root), whole, OF_MONTHS)
    mb.append(spark, root, again, "three")  # a repeated append replaces itself
    assert_equal(mb.as_cube(spark, root), whole, {k: ALL[k] for k in ("m01", "m11")})
    new = mb.bitmaps_of(late)
    assert "partial_bitmap_construct_agg" in inspect.physical_plan(new)


@pytest.mark.parametrize("name", [n for n in ("null_id", "null_order", "dupes", "null_month") if n in MICRO])
def test_bitmaps_of_micro_tables_row_by_row(spark, name):
    root = root_dir("bitmaps")
    k = len(MICRO[name]) // 2
    for label, part in (("a", MICRO[name][k:]), ("b", MICRO[name][:k])):
        mb.append(spark, root, table(spark, part), label)
    assert_equal(mb.as_cube(spark, root), table(spark, MICRO[name]), OF_MONTHS)


def test_ids_of_any_size(spark):
    from conftest import row
    root = root_dir("bitmaps")
    base = table(spark, [row(i, "2023-01-31") for i in (0, 1, -1, 32768, 32769, -32768, 10**15, -(10**15))])
    mb.append(spark, root, base, "a")
    mb.append(spark, root, base, "b")
    assert_equal(mb.as_cube(spark, root), base.unionByName(base), {k: ALL[k] for k in ("m01", "m03")})
