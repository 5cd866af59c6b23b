"""Revenue metrics: monthly totals, ARR by plan, plan mix, geography and
industry, the KPI snapshot, top customers and new customers of note."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierscope.functions.expr import (asc_pg, cents, cents_sum, desc_pg, exact_sum, from_cents,
                                      money_avg, plan_from_rank, plan_rank, plan_sort_key,
                                      plan_text_code, round_avg, whole_months, years_from_months)
from tierscope.operators.common import text_max_plan, unknown_plans
from tierscope.operators.latest import (latest_rows, max_month, nth_latest_month,
                                        previous_month)


def monthly_metrics(df: DataFrame) -> DataFrame:
    """Per month active and total customers, ARR and events of active rows.

    Two different distinct counts would make Spark expand every row three
    times (one copy per distinct key plus one for the plain sums). Instead
    rows are first combined per (month, customer) - a map-side partial
    aggregate - and the month totals are taken over those combined rows.
    The sums compose exactly, including the NULL of a month where every row
    is active with unknown ARR.
    """
    arr_cents = cents("annual_recurring_revenue")
    per_customer = df.groupBy("month_date", "id").agg(
        F.bool_or(F.col("is_active")).alias("any_active"),
        exact_sum(F.when(F.col("is_active"), arr_cents).otherwise(0)).alias("arr_all"),
        exact_sum(F.when(F.col("is_active"), arr_cents)).alias("arr_act"),
        F.count(F.when(F.col("is_active"), F.col("annual_recurring_revenue"))).alias("arr_n"),
        exact_sum(F.when(F.col("is_active"), F.col("events_28d")).otherwise(0)).alias("ev_all"),
        exact_sum(F.when(F.col("is_active"), F.col("events_28d"))).alias("ev_act"),
        F.count(F.when(F.col("is_active"), F.col("events_28d"))).alias("ev_n"),
    )
    m = per_customer.groupBy("month_date").agg(
        # NULL ids are not counted, as COUNT(DISTINCT ...) ignores them
        F.count_if(F.col("any_active") & F.col("id").isNotNull()).alias("active_customers"),
        F.count("id").alias("total_customers"),
        F.sum("arr_all").alias("total_arr"),
        F.sum("arr_act").alias("arr_act"), F.sum("arr_n").alias("arr_n"),
        F.sum("ev_all").alias("total_events_28d"),
        F.sum("ev_act").alias("ev_act"), F.sum("ev_n").alias("ev_n"),
    )
    return m.select(
        "month_date", "active_customers", "total_customers",
        from_cents("total_arr").alias("total_arr"),
        money_avg("arr_act", "arr_n").alias("avg_arr"),
        F.col("total_events_28d").cast("bigint").alias("total_events_28d"),
        round_avg("ev_act", "ev_n", 0).alias("avg_events_28d"),
    ).orderBy(asc_pg("month_date"))


def arr_by_plan(df: DataFrame) -> DataFrame:
    """Active rows per (month, plan): customers, total and average ARR."""
    g = df.filter(F.col("is_active")).groupBy("month_date", "plan").agg(
        F.count_distinct("id").alias("customers"),
        cents_sum("annual_recurring_revenue").alias("arr_c"),
        F.count(F.col("annual_recurring_revenue")).alias("arr_n"),
    )
    return g.select(
        "month_date", "plan", "customers",
        from_cents("arr_c").alias("total_arr"),
        money_avg("arr_c", "arr_n").alias("avg_arr"),
    ).orderBy(asc_pg("month_date"), plan_sort_key())


def plan_distribution(df: DataFrame) -> DataFrame:
    """Distinct active customers per (month, plan)."""
    return (df.filter(F.col("is_active")).groupBy("month_date", "plan")
            .agg(F.count_distinct("id").alias("customer_count"))
            .orderBy(asc_pg("month_date"), plan_sort_key()))


def breakdown_latest(df: DataFrame, dimension: str) -> DataFrame:
    """Latest month, active, known ``dimension`` value: distinct
    customers and total ARR per value, largest first (NULL totals first, as
    PostgreSQL sorts them)."""
    d = F.col(dimension)
    g = (latest_rows(df)
         .filter(d.isNotNull() & (d != "") & (F.col("is_active") == F.lit(True)))
         .groupBy(dimension)
         .agg(F.count_distinct("id").alias("unique_customers"),
              cents_sum("annual_recurring_revenue").alias("arr_c")))
    return (g.select(dimension, "unique_customers", from_cents("arr_c").alias("total_arr"))
            .orderBy(desc_pg("total_arr"), F.col(dimension)))


def revenue_by_geography(df: DataFrame) -> DataFrame:
    """M07."""
    return breakdown_latest(df, "country")


def industry_breakdown(df: DataFrame) -> DataFrame:
    """M08."""
    return breakdown_latest(df, "industry")


def latest_snapshot(df: DataFrame) -> DataFrame:
    """One row - active customers and ARR in the latest month and in the
    latest earlier month. Exactly one row even for an empty table
    (0, NULL, 0, NULL); a single month gives prev = 0 / NULL.

    Reads only the two months (partition filters), aggregates them in one
    pass, then pivots the two month rows into one.
    """
    latest = max_month(df)
    prev = previous_month(df)
    # Two equalities rather than IN (latest, prev): Spark 4.1 fails to push an
    # IN of scalar-subquery DATE values into a parquet scan of a data column.
    in_two = (F.col("month_date") == latest) | (F.col("month_date") == prev)
    per_month = (df.filter(in_two & F.col("is_active"))
                 .groupBy("month_date")
                 .agg(F.count_distinct("id").alias("n"),
                      cents_sum("annual_recurring_revenue").alias("s")))
    is_latest = F.col("month_date") == latest
    is_prev = F.col("month_date") == prev
    return per_month.agg(
        F.coalesce(F.max(F.when(is_latest, F.col("n"))), F.lit(0)).cast("bigint")
        .alias("active_customers"),
        from_cents(F.max(F.when(is_latest, F.col("s")))).alias("total_arr"),
        F.coalesce(F.max(F.when(is_prev, F.col("n"))), F.lit(0)).cast("bigint")
        .alias("prev_active_customers"),
        from_cents(F.max(F.when(is_prev, F.col("s")))).alias("prev_arr"),
    )


def top_customers(df: DataFrame, k: int = 10) -> DataFrame:
    """Latest month, active, ARR > 0: the k largest ARR (ties by id).
    ``years_as_client`` = whole months from account creation to the latest
    month, / 12, rounded to one place."""
    arr = F.col("annual_recurring_revenue")
    rows = latest_rows(df).filter((F.col("is_active") == F.lit(True)) & (arr > 0))
    return (rows.orderBy(desc_pg(F.col("annual_recurring_revenue")), asc_pg("id"))
            .limit(k)
            .select(F.col("id").alias("customer_id"),
                    F.col("annual_recurring_revenue").cast("double").alias("total_arr"),
                    years_from_months(whole_months("month_date", "account_created_date"))
                    .alias("years_as_client"),
                    "plan"))


def new_customers_of_note(df: DataFrame, k: int = 10, recent_months: int = 3,
                          nulls: str = "first", plan_by: str = "text",
                          with_first_seen: Callable[[DataFrame, Column], DataFrame] | None = None) -> DataFrame:
    """Customers first seen in one of the last 3 months present; the k
    with the largest ARR summed over their active rows (quirk K5), NULL sums
    first (K6), plan = MAX(plan) by text (K7).

    Options correcting the quirks: ``nulls="last"`` ranks never-paying
    customers (NULL sum) last (K6); ``plan_by="rank"`` reports the highest
    tier instead of the text maximum (K7).

    A customer first seen in the last n months has no dated row before them,
    so the join back to the table reads only those months (and undated rows)
    instead of every active row in history. ``with_first_seen(rows, cutoff)`` may
    add ``first_seen`` to the rows of customers first seen since then (and drop the
    others) from kept state; otherwise it is taken from the table.
    """
    cutoff = nth_latest_month(df, recent_months)
    # The MIN is combined map-side, so history is shuffled as one row per
    # customer and task; only newcomers are left for the join below.
    if with_first_seen is None:
        first_seen = (df.groupBy("id").agg(F.min("month_date").alias("first_seen"))
                      .filter(F.col("first_seen") >= cutoff))
        with_first_seen = lambda rows, _: rows.join(first_seen, "id")
    # rows of a NULL month belong to no month yet count for the customer;
    # they live in their own partition, so the pruning still holds
    in_window = (F.col("month_date") >= cutoff) | F.col("month_date").isNull()
    recent_active = (df.filter(in_window & F.col("is_active"))
                     .select("id", "month_date", "plan",
                             (plan_text_code() if plan_by == "text" else plan_rank())
                             .alias("plan_code"),
                             cents("annual_recurring_revenue").alias("arr_cents")))
    recent_active = with_first_seen(recent_active, cutoff)
    g = (recent_active.groupBy("id", "first_seen")
         .agg(F.max("plan_code").alias("plan_code"), unknown_plans().alias("other_plans"),
              exact_sum("arr_cents").alias("arr_sum"), F.max("month_date").alias("last_month")))
    if plan_by == "text":
        g = g.withColumn("plan", text_max_plan("plan_code", "other_plans"))
    else:
        g = g.withColumn("plan", plan_from_rank("plan_code")).drop("plan_code")
    by_arr = desc_pg("arr_sum") if nulls == "first" else F.col("arr_sum").desc_nulls_last()
    return (g.orderBy(by_arr, asc_pg("id"))
            .limit(k)
            .select(F.col("id").alias("customer_id"),
                    from_cents("arr_sum").alias("total_arr"),
                    years_from_months(whole_months("last_month", "first_seen"))
                    .alias("years_as_client"),
                    "plan",
                    F.col("first_seen").alias("joined_date")))
