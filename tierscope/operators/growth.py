"""Customer growth: churn, new customers by signup month, conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope.functions.expr import asc_pg, exact_sum, pct, round_div


def churn_metrics(df: DataFrame, calendar_strict: bool = False) -> DataFrame:
    """Per month, rows whose previous row (same customer, by month) was
    active, how many of them are now inactive, and that rate.

    "Previous row", not previous calendar month (quirk K1), and a customer
    whose rows stop is never counted (K2), as in the reference.

    The reference is a LAG over every row partitioned by customer, which
    would put all rows of one customer in one task. Here rows are first
    combined per (customer, month) - a map-side aggregate, so even a customer
    with a huge number of duplicate rows costs one row per month - and the
    LAG runs over at most one row per customer and month. Within one month
    duplicate rows are taken in the order NULL, FALSE, TRUE (the reference
    leaves that order undefined), which makes the within-month pairs
    countable from the three status counts:

    * rows with a non-NULL predecessor: the first row if the previous month
      ended non-NULL, plus every non-NULL row of the month but the last;
    * rows preceded by TRUE: the first row if the previous month ended TRUE,
      plus all TRUE rows of the month but one;
    * churned (TRUE then FALSE): only the first row, if it is FALSE and the
      previous month ended TRUE.

    ``calendar_strict=True`` (correcting K1) compares only with the previous
    calendar month: a customer absent that month has no predecessor.
    """
    per_month = df.groupBy("id", "month_date").agg(
        F.count_if(F.col("is_active").isNull()).alias("n_null"),
        F.count_if(~F.col("is_active")).alias("n_false"),
        F.count_if(F.col("is_active")).alias("n_true"),
    )
    last_status = (F.when(F.col("n_true") > 0, F.lit(True))
                   .when(F.col("n_false") > 0, F.lit(False)))
    w = Window.partitionBy("id").orderBy(asc_pg("month_date"))  # PostgreSQL: NULLs last
    prev = F.lag(last_status).over(w)
    if calendar_strict:
        month_no = lambda c: F.year(c) * 12 + F.month(c)
        adjacent = month_no(F.col("month_date")) - month_no(F.lag("month_date").over(w)) == 1
        prev = F.when(adjacent, prev)
    steps = per_month.select(
        "month_date", "n_null", "n_false", "n_true", prev.alias("prev_last"))
    return churn_rates(churn_totals(churn_steps(steps)))


def churn_steps(steps: DataFrame) -> DataFrame:
    """What each (customer, month) adds to M04, from its numbers of NULL, FALSE and TRUE
    rows and the status ``prev_last`` that the customer's month before ended with."""
    return steps.select("month_date", *[c.alias(name) for name, c in step_columns(
        "n_null", "n_false", "n_true", "prev_last").items()])


def step_columns(n_null: str, n_false: str, n_true: str, prev_last: str) -> dict[str, Column]:
    """The columns of ``churn_steps`` from the columns of these names."""
    nonnull = F.col(n_false) + F.col(n_true)
    prev_known = F.col(prev_last).isNotNull().cast("int")
    prev_true = F.coalesce(F.col(prev_last), F.lit(False)).cast("int")
    first_is_false = ((F.col(n_null) == 0) & (F.col(n_false) > 0)).cast("int")
    return {"with_prev": prev_known + F.greatest(nonnull - 1, F.lit(0)),
            "prev_active": prev_true + F.greatest(F.col(n_true) - 1, F.lit(0)),
            "churned": prev_true * first_is_false}


def churn_totals(contrib: DataFrame) -> DataFrame:
    """Sums of ``churn_steps`` (or of such sums) per month."""
    return contrib.groupBy("month_date").agg(
        *[F.sum(c).alias(c) for c in ("with_prev", "prev_active", "churned")])


def churn_rates(totals: DataFrame) -> DataFrame:
    """M04 from its totals per month."""
    m = totals.filter(F.col("with_prev") > 0).select(
        "month_date", F.col("prev_active").alias("prev_month_active_count"), F.col("churned").alias("churned_count"))
    return m.select(
        "month_date",
        F.col("prev_month_active_count").cast("bigint").alias("prev_month_active_count"),
        F.col("churned_count").cast("bigint").alias("churned_count"),
        pct("churned_count", "prev_month_active_count").alias("churn_rate_pct"),
    ).orderBy(asc_pg("month_date"))


def new_customers(df: DataFrame) -> DataFrame:
    """One row per customer with a known creation date - its earliest
    month's row (the reference's DISTINCT ON has no ORDER BY; ties broken by
    creation date, then first paid date) - counted per signup month, with
    how many of them ever paid.

    ``row_number() == 1`` is planned as a WindowGroupLimit whose partial step
    runs before the shuffle, so each map task sends at most one row per
    customer.
    """
    w = Window.partitionBy("id").orderBy(
        asc_pg("month_date"), "account_created_date", F.col("first_paid_date").asc_nulls_first())
    first = (df.filter(F.col("account_created_date").isNotNull())
             .select("id", "month_date", "account_created_date", "first_paid_date")
             .withColumn("rn", F.row_number().over(w))
             .filter(F.col("rn") == 1))
    return signups(first)


def signups(first: DataFrame) -> DataFrame:
    """M05 from the one row that counts of each customer."""
    g = first.groupBy(F.trunc("account_created_date", "month").alias("signup_month")).agg(
        F.count("id").alias("new_customers"),
        F.count(F.when(F.col("first_paid_date").isNotNull(), F.col("id"))).alias(
            "new_paying_customers"),
    )
    return g.orderBy("signup_month")


def conversion_funnel(df: DataFrame, require_free_start: bool = False) -> DataFrame:
    """One row - customers, customers that ever had ARR > 0, that share,
    and the mean days from first month to first paid month.

    Quirk K4: anyone with ARR > 0 counts as converted, even if paying from
    the first month; ``require_free_start=True`` counts only customers whose
    first month had no ARR > 0. An empty table gives one row (0, 0, NULL,
    NULL) where the reference would fail dividing by zero.
    """
    journey = df.groupBy("id").agg(
        F.min("month_date").alias("first_month"),
        F.min(F.when(F.col("annual_recurring_revenue") > 0, F.col("month_date")))
        .alias("first_paid_month"),
    )
    return funnel(journey, require_free_start)


def funnel(journey: DataFrame, require_free_start: bool = False) -> DataFrame:
    """M09 from the first and the first paid month of each customer."""
    if require_free_start:
        journey = journey.withColumn(
            "first_paid_month",
            F.when(F.col("first_paid_month") > F.col("first_month"), F.col("first_paid_month")))
    days = F.datediff("first_paid_month", "first_month")
    g = journey.agg(
        F.count("*").alias("total_users"),
        F.count("first_paid_month").alias("converted_users"),
        exact_sum(days).alias("days_sum"),
        F.count(days).alias("days_n"),
    )
    return g.select(
        "total_users", "converted_users",
        pct("converted_users", "total_users").alias("conversion_rate_pct"),
        round_div("days_sum", "days_n", 1).alias("avg_days_to_convert"),
    )
