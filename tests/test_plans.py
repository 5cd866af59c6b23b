"""Plan tests: the physical properties each operator is built to have."""

import pytest

from conftest import SF001
from tierscope.plans import inspect, registry
from tierscope.sources.base_table import load_base_table

LATEST_MONTH = ["m07_revenue_by_geography", "m08_industry_breakdown", "m12_inactive_rate_current",
                "m13_top_customers", "m16_power_users", "m17_at_risk_accounts"]
TOP_K = ["m13_top_customers", "m16_power_users", "m17_at_risk_accounts",
         "m18_high_opportunity_clients", "m14_new_customers_of_note"]


@pytest.fixture(scope="module")
def base(spark):
    return load_base_table(spark, SF001)


@pytest.mark.parametrize("name", sorted(registry.OPERATORS))
def test_no_python_in_any_plan(base, name):
    assert not inspect.uses_python(registry.OPERATORS[name](base))


@pytest.mark.parametrize("name", LATEST_MONTH + ["m10_latest_snapshot"])
def test_latest_month_is_a_partition_filter(base, name):
    filters = inspect.partition_filters(registry.OPERATORS[name](base))
    assert any("month_date" in f and "Subquery" in f for f in filters), filters


@pytest.mark.parametrize("name", ["m14_new_customers_of_note", "m18_high_opportunity_clients"])
def test_recent_months_prune_partitions(base, name):
    filters = inspect.partition_filters(registry.OPERATORS[name](base))
    assert any("month_date" in f and ("Subquery" in f or "dynamicpruning" in f) for f in filters)


@pytest.mark.parametrize("name", TOP_K)
def test_top_k_without_full_sort(base, name):
    assert inspect.has_node(registry.OPERATORS[name](base), "TakeOrderedAndProject")


def test_distinct_on_uses_map_side_group_limit(base):
    text = inspect.physical_plan(registry.OPERATORS["m05_new_customers"](base))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_active_filter_reaches_the_scan(base):
    pushed = inspect.pushed_filters(registry.OPERATORS["m02_arr_by_plan"](base))
    assert any("EqualTo(is_active,true)" in p for p in pushed)


@pytest.mark.parametrize("name", ["m01_monthly_metrics", "m11_mau_metrics", "r01_profile"])
def test_multi_distinct_without_row_expansion(base, name):
    assert not inspect.has_node(registry.OPERATORS[name](base), "Expand")


def test_scan_reads_only_needed_columns(base):
    text = inspect.physical_plan(registry.OPERATORS["m04_churn_metrics"](base))
    schema = [line for line in text.splitlines() if "ReadSchema" in line][0]
    assert "is_active" in schema and "plan" not in schema and "events" not in schema


@pytest.mark.parametrize("name", sorted(registry.OPERATORS))
def test_no_cross_join(base, name):
    text = inspect.physical_plan(registry.OPERATORS[name](base))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_fixture_derivation_has_no_cross_join(spark):
    from tierscope.sources.fixture import derive_base_table
    text = inspect.physical_plan(derive_base_table(spark, SF001))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
