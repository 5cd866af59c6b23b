"""Usage metrics: usage by plan, monthly active users, inactive rate, usage
trends, power users and at-risk accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.functions.expr import (asc_pg, desc_pg, exact_sum, pct, plan_sort_key, round_avg,
                                      round_div, round_half_up_double)
from tierscope.operators import quantile
from tierscope.operators.latest import latest_rows


# Thresholds of the reference's reports.
AT_RISK_MAX_EVENTS = 100
AT_RISK_MIN_ARR = 1000
DAYS_IN_WINDOW = 28


def usage_by_plan(df: DataFrame, exact_median: bool = True) -> DataFrame:
    """Active rows per plan over all months: customers, customer-months,
    rounded mean and median of daily and 28-day events, months with no
    events and their share.

    The medians are exact and distributed (``operators.quantile``: a
    (plan, value) histogram and a radix descent with bounded windows), not
    Spark's ``percentile``, whose final merge puts each plan's distinct
    values in one task. ``exact_median=False`` uses ``percentile_approx``.
    """
    active = df.filter(F.col("is_active"))
    aggs = [
        F.count_distinct("id").alias("unique_customers"),
        F.count("*").alias("customer_months"),
        exact_sum(F.col("events_daily")).alias("daily_sum"),
        F.count(F.col("events_daily")).alias("daily_n"),
        exact_sum(F.col("events_28d")).alias("ev_sum"), F.count(F.col("events_28d")).alias("ev_n"),
        F.count(F.when(F.col("events_28d") == 0, 1)).alias("inactive_months"),
    ]
    if not exact_median:
        aggs += [F.percentile_approx("events_daily", 0.5).cast("double").alias("daily_median"),
                 F.percentile_approx("events_28d", 0.5).cast("double").alias("ev_median")]
    g = active.groupBy("plan").agg(*aggs)
    if exact_median:
        # both medians in one pass: the two measures stacked, (plan, measure) as group
        long = active.selectExpr(
            "plan", "stack(2, 'daily_median', events_daily, 'ev_median', events_28d) "
                    "AS (measure, v)")
        med = (quantile.exact_median(long, ["plan", "measure"], "v", "m")
               .groupBy(F.col("plan").alias("_p"))
               .agg(*[F.max(F.when(F.col("measure") == m, F.col("m"))).alias(m)
                      for m in ("daily_median", "ev_median")]))
        # one row per plan on each side; AQE broadcasts by measured size
        g = g.join(med, g["plan"].eqNullSafe(med["_p"]), "left").drop("_p")
    return usage_summary(g)


def usage_summary(g: DataFrame) -> DataFrame:
    """M06's columns from counts, exact sums and medians per plan."""
    return g.select(
        "plan", "unique_customers", "customer_months",
        round_avg("daily_sum", "daily_n", 0).alias("avg_events_daily"),
        round_half_up_double("daily_median", 0).alias("median_events_daily"),
        round_avg("ev_sum", "ev_n", 0).alias("avg_events_28d"),
        round_half_up_double("ev_median", 0).alias("median_events_28d"),
        "inactive_months",
        pct("inactive_months", "customer_months").alias("pct_inactive"),
    ).orderBy(plan_sort_key())


def mau_metrics(df: DataFrame) -> DataFrame:
    """Per month, customers with events (MAU), active customers and MAU
    as a share of active ones (quirk K3: may exceed 100).

    Like M01, rows are combined per (month, customer) first so the two
    distinct counts need no row expansion.
    """
    per_customer = df.groupBy("month_date", "id").agg(
        F.bool_or(F.col("events_28d") > 0).alias("has_events"),
        F.bool_or(F.col("is_active")).alias("any_active"),
    )
    m = per_customer.groupBy("month_date").agg(
        # NULL ids are not counted, as COUNT(DISTINCT ...) ignores them
        F.count_if(F.col("has_events") & F.col("id").isNotNull()).alias("monthly_active_users"),
        F.count_if(F.col("any_active") & F.col("id").isNotNull()).alias("active_customers"),
    )
    return m.select(
        "month_date", "monthly_active_users", "active_customers",
        pct("monthly_active_users", "active_customers").alias("engagement_rate"),
    ).orderBy(asc_pg("month_date"))


def inactive_rate_current(df: DataFrame) -> DataFrame:
    """Latest month, active rows per plan: rows, rows without events,
    and their share."""
    g = (latest_rows(df).filter(F.col("is_active") == F.lit(True)).groupBy("plan")
         .agg(F.count("*").alias("total_customers"),
              F.count(F.when(F.col("events_28d") == 0, 1)).alias("inactive_count")))
    return g.select("plan", "total_customers", "inactive_count",
                    pct("inactive_count", "total_customers").alias("pct_inactive")) \
        .orderBy(plan_sort_key())


def usage_trends_by_plan(df: DataFrame) -> DataFrame:
    """Rounded mean 28-day events of active rows per (month, plan)."""
    g = (df.filter(F.col("is_active")).groupBy("month_date", "plan")
         .agg(exact_sum("events_28d").alias("ev_sum"), F.count("events_28d").alias("ev_n")))
    return (g.select("month_date", "plan", round_avg("ev_sum", "ev_n", 0).alias("avg_events"))
            .orderBy(asc_pg("month_date"), plan_sort_key()))


def _customer_usage(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("id").alias("customer_id"), "plan",
        F.col("annual_recurring_revenue").cast("double").alias("arr"),
        F.col("events_28d").alias("total_events"),
        round_div(F.col("events_28d"), F.lit(DAYS_IN_WINDOW), 1).alias("avg_events_per_day"),
    )


def power_users(df: DataFrame, k: int = 10) -> DataFrame:
    """Latest month, active, with events: the k with most events."""
    rows = latest_rows(df).filter((F.col("is_active") == F.lit(True)) & (F.col("events_28d") > 0))
    return _customer_usage(rows.orderBy(desc_pg("events_28d"), asc_pg("id")).limit(k))


def at_risk_accounts(df: DataFrame, k: int = 10, max_events: int = AT_RISK_MAX_EVENTS,
                     min_arr: float = AT_RISK_MIN_ARR) -> DataFrame:
    """Latest month, active, paying more than ``min_arr`` with fewer than
    ``max_events`` events (both strict): the k largest ARR."""
    arr, ev = F.col("annual_recurring_revenue"), F.col("events_28d")
    rows = latest_rows(df).filter((F.col("is_active") == F.lit(True)) & (arr > 0)
                                  & (ev < max_events) & (arr > min_arr))
    return _customer_usage(
        rows.orderBy(desc_pg("annual_recurring_revenue"), asc_pg("id")).limit(k))
