"""Registry of named queries over the base table.

Each entry maps a name to an operator taking the base-table DataFrame.
``queries()`` binds them to a test-data folder: the base table is derived
from that folder's TPC-H tables (once per session, stored under the
checkpoint folder) and the operator runs over all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tierscope.operators import growth, quality, report, revenue, segments, usage
from tierscope.functions.expr import FREE_TO_PAID, PAID_UPGRADE
from tierscope.sources.base_table import load_base_table

# Frames over M19, by name: a job that writes several computes M19 once.
REFERRAL_FRAMES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "m19_potential_referrals": lambda r: r,
    "a14_referrals_free_to_paid": lambda r: report.referral_split(r, FREE_TO_PAID),
    "a14_referrals_paid_upgrade": lambda r: report.referral_split(r, PAID_UPGRADE),
    "a15_referral_class_counts": report.referral_class_counts,
}

OPERATORS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "m01_monthly_metrics": revenue.monthly_metrics,
    "m02_arr_by_plan": revenue.arr_by_plan,
    "m03_plan_distribution": revenue.plan_distribution,
    "m04_churn_metrics": growth.churn_metrics,
    "m05_new_customers": growth.new_customers,
    "m06_usage_by_plan": usage.usage_by_plan,
    "m07_revenue_by_geography": revenue.revenue_by_geography,
    "m08_industry_breakdown": revenue.industry_breakdown,
    "m09_conversion_funnel": growth.conversion_funnel,
    "m10_latest_snapshot": revenue.latest_snapshot,
    "m11_mau_metrics": usage.mau_metrics,
    "m12_inactive_rate_current": usage.inactive_rate_current,
    "m13_top_customers": revenue.top_customers,
    "m14_new_customers_of_note": revenue.new_customers_of_note,
    "m15_usage_trends_by_plan": usage.usage_trends_by_plan,
    "m16_power_users": usage.power_users,
    "m17_at_risk_accounts": usage.at_risk_accounts,
    "m18_high_opportunity_clients": segments.high_opportunity_clients,
    "m19_potential_referrals": segments.potential_referrals,
    # report frames over the metric operators (pandas steps in the reference)
    "a01_kpi_growth": lambda df: report.kpi_growth(revenue.latest_snapshot(df)),
    "a03_arr_moving_average": lambda df: report.moving_average(revenue.monthly_metrics(df)),
    "a04_arr_pivot_by_plan": lambda df: report.pivot_by_plan(revenue.arr_by_plan(df)),
    "a06_arr_stacked_by_plan": lambda df: report.stacked_by_plan(revenue.arr_by_plan(df)),
    "a07_plan_mix_latest": lambda df: report.plan_mix_latest(revenue.plan_distribution(df)),
    "a09_top_countries_bar": lambda df: report.top_by_value(
        revenue.revenue_by_geography(df), "country"),
    "a11_top_customers_table": lambda df: report.top_customers_table(revenue.top_customers(df)),
    "a12_new_customers_table": lambda df: report.new_customers_table(
        revenue.new_customers_of_note(df)),
    "a13_power_users_table": lambda df: report.usage_table(usage.power_users(df)),
    "a13_at_risk_table": lambda df: report.usage_table(usage.at_risk_accounts(df)),
    "a13_opportunity_table": lambda df: report.opportunity_table(
        segments.high_opportunity_clients(df)),
    "a13_industry_table": lambda df: report.breakdown_table(
        revenue.industry_breakdown(df), "industry"),
    "a13_country_table": lambda df: report.breakdown_table(
        revenue.revenue_by_geography(df), "country"),
    "a13_usage_summary_table": lambda df: report.usage_summary_table(usage.usage_by_plan(df)),
    "a09_top_industries_bar": lambda df: report.top_by_value(
        revenue.industry_breakdown(df), "industry"),
    "a19_kpi_text": lambda df: report.kpi_text(
        report.kpi_growth(revenue.latest_snapshot(df)), growth.conversion_funnel(df)),
    "a14_referrals_free_to_paid": lambda df: report.referral_split(
        segments.potential_referrals(df), FREE_TO_PAID),
    "a14_referrals_paid_upgrade": lambda df: report.referral_split(
        segments.potential_referrals(df), PAID_UPGRADE),
    "a15_referral_class_counts": lambda df: report.referral_class_counts(
        segments.potential_referrals(df)),
    "a20_mau_long": lambda df: report.mau_long(usage.mau_metrics(df)),
    # data-quality checks (stated only in prose in the reference)
    "r01_profile": quality.profile,
    "r02_completeness": quality.completeness,
    "r03_free_plan_with_arr": quality.free_plan_with_arr,
    "r04_duplicate_keys": quality.duplicate_keys,
    "r04_month_gaps": quality.month_gaps,
    "r04_stopped_customers": quality.stopped_customers,
}


def bind(op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return op(load_base_table(spark, sf_dir))
    run.__name__ = getattr(op, "__name__", "query")
    run.__doc__ = op.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: bind(op) for name, op in OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    from tierscope.plans import oracle
    return {name: oracle.M[name] for name in OPERATORS if name in oracle.M}
