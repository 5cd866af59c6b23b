"""The month-local reports from one pass over the table.

Rows are combined per (month, customer, plan, country, industry) first, map-side;
each combined row then counts for its month, its plan and, in the latest month, its
country and industry, as in ``GROUPING SETS ((month), (month, plan), (month, country),
(month, industry))``. What comes out has one row per month and value and feeds M01,
M02, M03, M07, M08, M10, M11, M12 and M15, and the frames over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope.functions.expr import (asc_pg, cents, desc_pg, exact_sum, from_cents, money_avg, pct, plan_sort_key,
                                      round_avg)
from tierscope.operators.latest import max_month

COUNTS = ["n_rows", "n_active", "n_idle", "arr_n", "ev_n"]
SUMS = ["arr", "ev"]


def measures() -> list[Column]:
    """Additive measures of base rows: all rows, active rows, active rows without events,
    and sums and counts of ARR (in cents) and events over active rows."""
    active = F.col("is_active")
    events, arr = F.col("events_28d"), F.col("annual_recurring_revenue")
    return [F.count("*").alias("n_rows"), F.count_if(active).alias("n_active"),
            F.count_if(active & (events == 0)).alias("n_idle"),
            F.count(F.when(active, arr)).alias("arr_n"), F.count(F.when(active, events)).alias("ev_n"),
            exact_sum(F.when(active, cents(arr))).alias("arr"), exact_sum(F.when(active, events)).alias("ev")]


def month_cube(df: DataFrame, all_months: bool = False) -> DataFrame:
    """``(month_date, scope, value, active_customers, total_customers, used_customers,
    n_rows, n_active, n_idle, arr_n, ev_n, arr, ev)``; scope is month, plan, country or
    industry. Country and industry (neither NULL nor blank) are kept for the latest month,
    which the reports ask for, or for ``all_months``."""
    per = df.groupBy("month_date", "id", "plan", "country", "industry").agg(
        *measures(), F.count_if(F.col("events_28d") > 0).alias("n_used"))
    wanted = F.lit(True) if all_months else F.col("month_date") == max_month(df)
    of = lambda name, value: F.struct(F.lit(name).alias("scope"), value.cast("string").alias("value"))
    known = lambda c: F.when(wanted & F.col(c).isNotNull() & (F.col(c) != ""), of(c, F.col(c)))
    scopes = F.array_compact(F.array(of("month", F.lit(None)), of("plan", F.col("plan")), known("country"), known("industry")))
    flags = ["n_used"]
    long = per.select("month_date", "id", F.explode(scopes).alias("s"), *COUNTS, *SUMS, *flags).select(
        "month_date", "id", "s.scope", "s.value", *COUNTS, *SUMS, *flags)
    by_id = long.groupBy("month_date", "scope", "value", "id").agg(*[F.sum(c).alias(c) for c in COUNTS + SUMS + flags])
    has_id = F.col("id").isNotNull()  # COUNT(DISTINCT id) skips a NULL id
    return by_id.groupBy("month_date", "scope", "value").agg(
        F.count_if(has_id & (F.col("n_active") > 0)).alias("active_customers"),
        F.count("id").alias("total_customers"),
        F.count_if(has_id & (F.col("n_used") > 0)).alias("used_customers"),
        *[F.sum(c).alias(c) for c in COUNTS + SUMS])


def _months(cube: DataFrame) -> DataFrame:
    return cube.where("scope = 'month'")


def _plans(cube: DataFrame) -> DataFrame:
    return cube.where("scope = 'plan' AND n_active > 0").withColumnRenamed("value", "plan")


def _latest(cube: DataFrame) -> DataFrame:
    """The cube's rows of its last month. The month comes from a window over the cube (one
    row per month and value): a subquery would compute the cube once more."""
    last = F.max(F.when(F.col("scope") == "month", F.col("month_date"))).over(Window.partitionBy())
    return cube.withColumn("_last", last).where("month_date = _last").drop("_last")


def monthly_metrics(cube: DataFrame) -> DataFrame:
    """M01. A row that isn't active adds 0, so the total is NULL only if all rows of a
    month are active and none has a value."""
    total = lambda c: F.when(F.col("n_rows") > F.col("n_active"), F.coalesce(F.col(c), F.lit(0))).otherwise(F.col(c))
    return _months(cube).select(
        "month_date", "active_customers", "total_customers", from_cents(total("arr")).alias("total_arr"),
        money_avg("arr", "arr_n").alias("avg_arr"), total("ev").cast("bigint").alias("total_events_28d"),
        round_avg("ev", "ev_n", 0).alias("avg_events_28d")).orderBy(asc_pg("month_date"))


def arr_by_plan(cube: DataFrame) -> DataFrame:
    """M02."""
    return _plans(cube).select(
        "month_date", "plan", F.col("active_customers").alias("customers"), from_cents("arr").alias("total_arr"),
        money_avg("arr", "arr_n").alias("avg_arr")).orderBy(asc_pg("month_date"), plan_sort_key())


def plan_distribution(cube: DataFrame) -> DataFrame:
    """M03."""
    return _plans(cube).select("month_date", "plan", F.col("active_customers").alias("customer_count")).orderBy(
        asc_pg("month_date"), plan_sort_key())


def breakdown_latest(cube: DataFrame, dimension: str) -> DataFrame:
    """M07 (``country``) and M08 (``industry``)."""
    rows = _latest(cube).where((F.col("scope") == dimension) & (F.col("n_active") > 0))
    return rows.select(F.col("value").alias(dimension), F.col("active_customers").alias("unique_customers"),
                       from_cents("arr").alias("total_arr")).orderBy(desc_pg("total_arr"), F.col(dimension))


def latest_snapshot(cube: DataFrame) -> DataFrame:
    """M10. Months are ranked (one row each), so that the cube is computed once."""
    months = _months(cube).where("month_date IS NOT NULL").withColumn(
        "rank", F.dense_rank().over(Window.orderBy(F.col("month_date").desc())))
    at = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    return months.agg(
        F.coalesce(at(1, "active_customers"), F.lit(0)).cast("bigint").alias("active_customers"),
        from_cents(at(1, "arr")).alias("total_arr"),
        F.coalesce(at(2, "active_customers"), F.lit(0)).cast("bigint").alias("prev_active_customers"),
        from_cents(at(2, "arr")).alias("prev_arr"))


def mau_metrics(cube: DataFrame) -> DataFrame:
    """M11."""
    return _months(cube).select(
        "month_date", F.col("used_customers").alias("monthly_active_users"), "active_customers",
        pct("used_customers", "active_customers").alias("engagement_rate")).orderBy(asc_pg("month_date"))


def inactive_rate_current(cube: DataFrame) -> DataFrame:
    """M12."""
    return _plans(_latest(cube)).select(
        "plan", F.col("n_active").alias("total_customers"), F.col("n_idle").alias("inactive_count"),
        pct("n_idle", "n_active").alias("pct_inactive")).orderBy(plan_sort_key())


def usage_trends_by_plan(cube: DataFrame) -> DataFrame:
    """M15."""
    return _plans(cube).select("month_date", "plan", round_avg("ev", "ev_n", 0).alias("avg_events")).orderBy(
        asc_pg("month_date"), plan_sort_key())
