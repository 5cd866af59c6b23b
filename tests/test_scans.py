"""What the final plans read: month partitions, scans, reused and partial steps."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from tierscope.operators import latest
from tierscope.plans import inspect, registry
from tierscope.sources.base_table import load_base_table

ONE_MONTH = ["m07_revenue_by_geography", "m08_industry_breakdown", "m12_inactive_rate_current",
             "m13_top_customers", "m16_power_users", "m17_at_risk_accounts"]


@pytest.fixture(scope="module")
def base(spark):
    return load_base_table(spark, SF001)


def table_scans(text):
    """FileScan lines of the base table. The month list is another table, in which
    month_date is a data column."""
    return [s for s in re.findall(r"FileScan parquet [^\n]*", text) if "month_date" not in s.split("ReadSchema")[-1]]


@pytest.mark.parametrize("name", [*ONE_MONTH, "m10_latest_snapshot", "m18_high_opportunity_clients"])
def test_every_scan_has_a_month_filter(base, name):
    scans = table_scans(inspect.executed_plan(registry.OPERATORS[name](base)))
    assert scans
    for s in scans:
        filters = s.split("PartitionFilters: ")[1].split("PushedFilters")[0]
        assert "subquery" in filters.lower(), s


def test_month_list_equals_the_table(base):
    got = {tuple(r) for r in latest.months_of(base).collect()}
    assert got == {tuple(r) for r in base.groupBy("month_date").agg(F.count("*")).collect()}
    assert latest._MONTHS.get(base) is not None


def test_medians_read_the_table_twice_at_most(base):
    text = inspect.executed_plan(registry.OPERATORS["m06_usage_by_plan"](base)).split("== Initial Plan ==")[0]
    assert len(table_scans(text)) <= 2 and "ReusedExchange" in text


@pytest.mark.parametrize("name", ["m14_new_customers_of_note", "r03_free_plan_with_arr"])
def test_history_is_combined_before_it_is_shuffled(spark, base, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = inspect.physical_plan(registry.OPERATORS[name](base))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "partial_min" in text or "partial_count" in text
    assert "LeftSemi" not in text


@pytest.mark.parametrize("name", ["m19_potential_referrals", "r01_profile", "r02_completeness"])
def test_one_read(base, name):
    # the text shows the final and the initial plan, each with its scans
    assert len(table_scans(inspect.executed_plan(registry.OPERATORS[name](base)))) == 2


@pytest.mark.parametrize("name", ["r03_free_plan_with_arr", "r04_month_gaps", "r04_duplicate_keys", "r04_stopped_customers"])
def test_no_global_sort(base, name):
    assert "rangepartitioning" not in inspect.physical_plan(registry.OPERATORS[name](base))


def test_bar_and_plan_orders(base):
    bar = [r.total_arr for r in registry.OPERATORS["a09_top_industries_bar"](base).collect()]
    assert bar == sorted(bar, key=lambda v: (v is None, v))
    plans = [r["Plan"] for r in registry.OPERATORS["a13_usage_summary_table"](base).collect()]
    known = ["Free", "Trial", "Low", "Middle", "Top", None]
    assert plans == [p for p in known if p in plans]
