"""Sales segments: upsell opportunities and referral candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.functions.expr import (FREE_TIERS, FREE_TO_PAID, PAID_UPGRADE, asc_pg, desc_pg,
                                      exact_sum, plan_from_rank, plan_rank, plan_text_code,
                                      round_avg, whole_months)
from tierscope.operators.common import text_max_plan, unknown_plans
from tierscope.operators.latest import recent_rows


# Thresholds of the reference's reports.
OPPORTUNITY_MIN_AVG_EVENTS = 500
REFERRAL_MIN_AVG_EVENTS = 100
REFERRAL_MAX_MONTHS = 6


def high_opportunity_clients(df: DataFrame, k: int = 15, recent_months: int = 6,
                             min_avg_events: int = OPPORTUNITY_MIN_AVG_EVENTS) -> DataFrame:
    """Last 6 months present, active Free/Trial rows with events, per
    (customer, plan, creation date): mean events above ``min_avg_events``
    (strict, on the unrounded mean); the k highest means.

    The month filter is a partition filter; the threshold test is exact
    integer arithmetic (sum > threshold * count).
    """
    ev = F.col("events_28d")
    rows = recent_rows(df, recent_months).filter(
        (F.col("is_active") == F.lit(True)) & F.col("plan").isin(*FREE_TIERS) & (ev > 0))
    g = (rows.groupBy("id", "plan", "account_created_date")
         .agg(exact_sum(ev).alias("ev_sum"), F.count(ev).alias("ev_n"),
              F.avg(ev).alias("avg_events"), F.max(ev).alias("peak_events_28d"),
              F.count("*").alias("months_active"))
         .filter(F.col("ev_sum") > F.col("ev_n") * min_avg_events))
    return (g.orderBy(desc_pg("avg_events"), asc_pg("id"), asc_pg("plan"),
                      asc_pg("account_created_date"))
            .limit(k)
            .select(F.col("id").alias("customer_id"), "plan",
                    round_avg("ev_sum", "ev_n", 0).alias("avg_events_28d"),
                    "peak_events_28d", "months_active",
                    F.col("account_created_date").alias("joined_date")))


def potential_referrals(df: DataFrame, max_months: int = REFERRAL_MAX_MONTHS,
                        min_avg_events: int = REFERRAL_MIN_AVG_EVENTS,
                        ordered: bool = False, plan_by: str = "text") -> DataFrame:
    """Customers whose plan rank rose within their first ``max_months``
    whole months (any row up to that age, negative ages included - K10) and
    whose rounded mean events exceed ``min_avg_events`` (K13).

    Kept as in the reference: a rise is MAX(rank) > MIN(rank) regardless of
    time order (K8); the plan names are MIN over Free/Trial rows and MAX by
    text (K7, K9); Free -> Trial only is dropped. Ordered by class, then mean
    events (highest first), then customer.

    Options correcting the quirks: ``ordered=True`` compares the tier of the
    first month with the tier of the last month (a downgrade no longer
    qualifies, K8) and names those two plans; ``plan_by="rank"`` names the
    highest tier instead of the text maximum (K7).
    """
    h = (df.filter(F.col("account_created_date").isNotNull())
         .filter(whole_months("month_date", "account_created_date") <= max_months)
         .select("id", "month_date", "plan", "account_created_date", "events_28d",
                 plan_rank().alias("plan_rank"), plan_text_code().alias("plan_code")))
    r = F.col("plan_rank")
    # Integer aggregates only (hash aggregation): the Free/Trial start name
    # is the one with the lower rank (their text order is their rank order),
    # and MAX(plan) by text comes from a text-order code (common.text_max_plan).
    if ordered:
        # first / last known tier in time order (ties within a month: lower
        # tier first), as integer keys so min_by/max_by stay hash aggregates
        key = F.when(r.isNotNull(), F.datediff("month_date", F.lit("1970-01-01")) * 8 + r)
        s_expr, e_expr = F.min_by(r, key), F.max_by(r, key)
    else:
        s_expr, e_expr = F.min(r), F.max(r)
    g = (h.groupBy("id").agg(
        s_expr.alias("s_rank"), e_expr.alias("e_rank"),
        F.min(F.when(r.isin(1, 2), r)).alias("start_rank"),
        F.max("plan_code" if plan_by == "text" else "plan_rank").alias("plan_code"),
        unknown_plans().alias("other_plans"),
        exact_sum("events_28d").alias("ev_sum"), F.count("events_28d").alias("ev_n"),
        F.max("events_28d").alias("peak_events"),
        F.count_distinct("month_date").alias("months_observed"),
        F.min("account_created_date").alias("joined_date"))
        .filter(F.col("e_rank") > F.col("s_rank"))
        .withColumn("starting_plan_name",
                    plan_from_rank("s_rank" if ordered else "start_rank")))
    s, e = F.col("s_rank"), F.col("e_rank")
    to_paid = s.isin(1, 2) & (e >= 3)
    paid_up = (s >= 3) & (e > s)
    upgrade_type = F.when(to_paid, F.lit(FREE_TO_PAID)).when(paid_up, F.lit(PAID_UPGRADE))
    out = (g.withColumn("avg_events", round_avg("ev_sum", "ev_n", 0))
           .filter((F.col("avg_events") > min_avg_events) & (to_paid | paid_up)))
    if ordered:
        out = out.withColumn("ending_plan_name", plan_from_rank("e_rank")).drop("plan_code")
    elif plan_by == "text":
        out = out.withColumn("ending_plan_name", text_max_plan("plan_code", "other_plans"))
    else:
        out = out.withColumn("ending_plan_name", plan_from_rank("plan_code")).drop("plan_code")
    out = (out.withColumn("upgrade_type", upgrade_type)
           .withColumn("class_order", F.when(to_paid, 1).when(paid_up, 2)))
    return (out.orderBy("class_order", desc_pg("avg_events"), asc_pg("id"))
            .select(F.col("id").alias("customer_id"), "starting_plan_name",
                    "ending_plan_name", "avg_events", "peak_events", "months_observed",
                    "joined_date", "upgrade_type"))
