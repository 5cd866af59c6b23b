"""Report frames: the reference's pandas post-processing as DataFrame steps.

Each function takes the output of a metric operator (still lazy) and returns
another lazy DataFrame, so metric + report step run as one Spark job. Inputs
are small (one row per month, plan or top-k row); single-partition windows
are used only on such already-aggregated frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierscope.functions.expr import (asc_pg, FREE_TO_PAID, PAID_UPGRADE, PLAN_ORDER, col, pct,
                                      plan_rank)

# The stacking order of the ARR-by-plan area chart.
STACK_ORDER = ["Top", "Middle", "Low", "Trial", "Free"]

_CENTS = "decimal(38,2)"


def _money(c) -> Column:
    """A money DOUBLE (produced from exact cents) back to exact cents."""
    return col(c).cast(_CENTS)


# ---- A01 / A02 -------------------------------------------------------------

def growth_pct(cur, prev) -> Column:
    """``(cur - prev) / prev * 100`` if prev > 0, else 0."""
    cur, prev = col(cur).cast("double"), col(prev).cast("double")
    return F.when(prev > 0, (cur - prev) / prev * 100).otherwise(F.lit(0.0))


def kpi_growth(snapshot: DataFrame) -> DataFrame:
    """A01 + A02 over the M10 snapshot: month-over-month growth of active
    customers and ARR, and average ARR per active customer (0 if none)."""
    active = F.col("active_customers")
    return snapshot.select(
        "active_customers", "total_arr", "prev_active_customers", "prev_arr",
        growth_pct("active_customers", "prev_active_customers").alias("customer_growth_pct"),
        growth_pct("total_arr", "prev_arr").alias("arr_growth_pct"),
        F.when(active > 0, F.col("total_arr") / active.cast("double"))
         .otherwise(F.lit(0.0)).alias("avg_arr_per_customer"),
    )


# ---- A03 --------------------------------------------------------------------

def moving_average(monthly: DataFrame, value: str = "total_arr", window: int = 3,
                   out: str = "arr_3mo_ma") -> DataFrame:
    """Trailing mean over the last ``window`` rows (at least one row;
    NULLs skipped), like pandas ``rolling(window, min_periods=1).mean()``.

    The sum is taken over exact cents, so the value doesn't depend on the order
    of floating-point additions; the quotient isn't rounded.
    """
    w = Window.orderBy(asc_pg("month_date")).rowsBetween(-(window - 1), 0)
    return monthly.select(
        "month_date", value,
        F.when(F.count(value).over(w) > 0, F.sum(_money(value)).over(w).cast("double")
               / F.count(value).over(w)).alias(out),
    ).orderBy(asc_pg("month_date"))


# ---- A04 / A05 / A06 --------------------------------------------------------

def pivot_by_plan(arr_by_plan: DataFrame, value: str = "total_arr",
                  plans: list[str] | None = None) -> DataFrame:
    """A04 + A05: (month x plan) matrix of ``value``, missing cells and NULLs
    as 0, columns in chart order (Top, Middle, Low, Trial, Free). The explicit
    value list avoids the extra job Spark runs to discover pivot values."""
    plans = plans or STACK_ORDER
    p = (arr_by_plan.groupBy("month_date").pivot("plan", plans)
         .agg(F.sum(_money(value))))
    return p.select("month_date", *[F.coalesce(F.col(f"`{pl}`"), F.lit(0)).cast("double")
                                    .alias(pl) for pl in plans]).orderBy(asc_pg("month_date"))


def stacked_by_plan(arr_by_plan: DataFrame, value: str = "total_arr",
                    plans: list[str] | None = None) -> DataFrame:
    """The stacked-area series. Long form over every (month, plan) of the
    zero-filled pivot; ``stacked_arr`` is the running sum across plans in
    stack order within the month (exact cents)."""
    plans = plans or STACK_ORDER
    wide = pivot_by_plan(arr_by_plan, value, plans)
    stack = ", ".join(f"{i}, '{pl}', `{pl}`" for i, pl in enumerate(plans))
    long = wide.selectExpr("month_date", f"stack({len(plans)}, {stack}) AS (pos, plan, v)")
    w = Window.partitionBy("month_date").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return long.select(
        "month_date", "plan", F.col("v").alias(value),
        F.sum(_money("v")).over(w).cast("double").alias("stacked_arr"),
    ).orderBy(asc_pg("month_date"), "plan")


# ---- A07 / A08 --------------------------------------------------------------

def latest_slice(df: DataFrame) -> DataFrame:
    """Rows at the latest month of *this* frame (not of the base table)."""
    return df.filter(F.col("month_date") == df.select(F.max("month_date")).scalar())


def share_of_total(df: DataFrame, value: str, out: str = "share_pct") -> DataFrame:
    """Each row's share of the column total, in percent (2 places,
    exact). Meant for small frames (a pie of at most a few rows)."""
    total = F.sum(value).over(Window.partitionBy())
    return df.withColumn(out, pct(F.col(value), total))


def plan_mix_latest(plan_distribution: DataFrame) -> DataFrame:
    """A07 + A08 over M03: plan shares of active customers in the last month."""
    return share_of_total(latest_slice(plan_distribution), "customer_count") \
        .orderBy(plan_rank().asc_nulls_last())


# ---- A09 / A16 / A17 --------------------------------------------------------

def head(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows of an ordered result; the order must be restated
    because a DataFrame has none of its own after a shuffle."""
    return df.orderBy(*order).limit(n)


def top_by_value(df: DataFrame, key: str, value: str = "total_arr", n: int = 10) -> DataFrame:
    """A09 + A16: the n largest ``value`` rows (NULL first, ties by key), then
    ascending for a horizontal bar chart."""
    top = head(df, n, F.col(value).desc_nulls_first(), F.col(key))
    return top.orderBy(F.col(value).asc_nulls_last(), F.col(key).desc())


def order_by_plan(df: DataFrame, *then: str) -> DataFrame:
    """Free, Trial, Low, Middle, Top (unknown plans last)."""
    return df.orderBy(plan_rank().asc_nulls_last(), *then)


# ---- A10 / A11 / A12 / A19 --------------------------------------------------

def fill_null(c, value=0) -> Column:
    """A10: NULL -> 0."""
    return F.coalesce(col(c), F.lit(value))


def currency_text(c, places: int = 0) -> Column:
    """``$1,234`` / ``$1,234.56``. Rounds half-to-even on the exact
    decimal value."""
    return F.concat(F.lit("$"), F.format_number(col(c).cast(_CENTS), places))


def month_year(c) -> Column:
    """``Jan 2023``."""
    return F.date_format(col(c), "MMM yyyy")


def signed_pct_text(c, suffix: str = "% MoM") -> Column:
    """``+3.2% MoM``, rounded half to even on the double's exact value, as
    Python formats it."""
    exact = F.format_number(F.abs(col(c).cast("double")).cast("decimal(38,18)"), 1)
    sign = F.when(col(c) < 0, F.lit("-")).otherwise(F.lit("+"))
    return F.concat(sign, F.replace(exact, F.lit(","), F.lit("")), F.lit(suffix))


def count_text(c) -> Column:
    """Thousands separators for a count."""
    return F.format_number(col(c).cast("decimal(38,0)"), 0)


# ---- A13 report layouts -----------------------------------------------------

def top_customers_table(top: DataFrame) -> DataFrame:
    """A10 + A11 + A13 over M13."""
    return top.select(
        F.col("customer_id").alias("Customer ID"),
        currency_text(fill_null("total_arr"), 2).alias("Total ARR"),
        F.col("years_as_client").alias("Years as Client"),
        F.col("plan").alias("Plan"))


def new_customers_table(new: DataFrame) -> DataFrame:
    """A10 + A11 + A12 + A13 over M14."""
    return new.select(
        F.col("customer_id").alias("Customer ID"),
        currency_text(fill_null("total_arr"), 0).alias("Total ARR"),
        month_year("joined_date").alias("Joined"),
        F.col("plan").alias("Plan"))


def usage_table(usage: DataFrame) -> DataFrame:
    """A10 + A11 + A13 over M16 or M17."""
    return usage.select(
        F.col("customer_id").alias("Customer ID"), F.col("plan").alias("Plan"),
        currency_text(fill_null("arr"), 0).alias("ARR"),
        F.col("total_events").alias("Total Events (28d)"),
        F.col("avg_events_per_day").alias("Avg Events/Day"))


def opportunity_table(opp: DataFrame) -> DataFrame:
    """A12 + A13 over M18."""
    return opp.select(
        F.col("customer_id").alias("Customer ID"), F.col("plan").alias("Current Plan"),
        F.col("avg_events_28d").alias("Avg Events (28d)"),
        F.col("peak_events_28d").alias("Peak Events"),
        F.col("months_active").alias("Months Active"),
        month_year("joined_date").alias("Joined"))


def breakdown_table(breakdown: DataFrame, key: str, n: int = 10) -> DataFrame:
    """A09 + A11 + A13 over M07/M08: top n with ARR as whole dollars."""
    top = head(breakdown, n, F.col("total_arr").desc_nulls_first(), F.col(key))
    return top.select(key, "unique_customers", currency_text("total_arr", 0).alias("total_arr"))


def usage_summary_table(usage: DataFrame) -> DataFrame:
    """A13 + A17 over M06: the usage summary, plans in tier order."""
    return order_by_plan(usage).select(
        F.col("plan").alias("Plan"), F.col("unique_customers").alias("Customers"),
        F.col("customer_months").alias("Customer Months"),
        F.col("avg_events_daily").alias("Avg Daily Events"),
        F.col("median_events_daily").alias("Median Daily Events"),
        F.col("avg_events_28d").alias("Avg 28d Events"),
        F.col("median_events_28d").alias("Median 28d Events"),
        F.col("inactive_months").alias("Inactive Months"),
        F.col("pct_inactive").alias("% Inactive"))


def kpi_text(growth: DataFrame, funnel: DataFrame) -> DataFrame:
    """The texts of the KPI strip, from A01/A02 (one row) and M09 (one row).
    An average without customers is $0; an unknown total or rate counts as 0."""
    one = lambda df, c: df.select(c).scalar()
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return growth.select(
        count_text("active_customers").alias("active_customers"),
        signed_pct_text("customer_growth_pct").alias("customer_growth"),
        currency_text(zero(F.col("total_arr")), 0).alias("total_arr"),
        signed_pct_text(zero(F.col("arr_growth_pct"))).alias("arr_growth"),
        currency_text(F.round(zero(F.col("avg_arr_per_customer")), 2), 0).alias("avg_arr_per_customer"),
        F.concat(F.format_number(zero(one(funnel, "conversion_rate_pct")).cast("decimal(38,2)"), 1),
                 F.lit("%")).alias("conversion_rate"))


# ---- A14 / A15 --------------------------------------------------------------

def referral_split(referrals: DataFrame, upgrade_type: str) -> DataFrame:
    """A14 + A12 + A13: one class of M19 as its display table."""
    return (referrals.filter(F.col("upgrade_type") == upgrade_type)
            .select(F.col("customer_id").alias("Customer ID"),
                    F.col("starting_plan_name").alias("From"),
                    F.col("ending_plan_name").alias("To"),
                    F.col("avg_events").alias("Avg Events"),
                    F.col("peak_events").alias("Peak Events"),
                    month_year("joined_date").alias("Joined")))


def referral_class_counts(referrals: DataFrame) -> DataFrame:
    """Rows per upgrade class."""
    return referrals.groupBy("upgrade_type").agg(F.count("*").alias("customers"))


# ---- A20 --------------------------------------------------------------------

def mau_long(mau: DataFrame) -> DataFrame:
    """M11's two measures as one long (month, series, value) frame."""
    return (mau.select("month_date", "monthly_active_users", "active_customers")
            .unpivot("month_date", ["monthly_active_users", "active_customers"],
                     "series", "value")
            .orderBy(asc_pg("month_date"), "series"))


__all__ = ["FREE_TO_PAID", "PAID_UPGRADE", "PLAN_ORDER", "STACK_ORDER", "breakdown_table",
           "count_text", "currency_text", "fill_null", "growth_pct", "head", "kpi_growth",
           "latest_slice", "mau_long", "month_year", "moving_average", "new_customers_table",
           "opportunity_table", "order_by_plan", "pivot_by_plan", "plan_mix_latest",
           "referral_class_counts", "referral_split", "share_of_total", "signed_pct_text",
           "kpi_text", "stacked_by_plan", "top_by_value", "top_customers_table",
           "usage_summary_table", "usage_table"]
