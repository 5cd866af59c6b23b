"""Data-quality checks the reference states only in prose: dataset profile,
completeness of country/industry, Free-plan rows that carry ARR, and the
(customer, month) grain.

All are aggregations or bounded windows; none collects rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierscope.functions.expr import asc_pg, PLAN_ORDER, pct, plan_from_rank, plan_rank
from tierscope.operators.latest import max_month, months_of


def profile(df: DataFrame) -> DataFrame:
    """Rows, distinct customers, first/last month and distinct months.

    Rows are combined per customer first (map-side partial aggregate), so
    the exact distinct count needs no row expansion; the month facts come
    from the month list.
    """
    per_id = df.groupBy("id").agg(F.count("*").alias("n"))
    months = months_of(df).select(F.struct(F.min("month_date").alias("lo"), F.max("month_date").alias("hi"),
                                F.count_distinct("month_date").alias("k"))).scalar()
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("records"),
        F.count("id").alias("unique_customers"),
    ).select("records", "unique_customers",
             months.getField("lo").alias("first_month"),
             months.getField("hi").alias("last_month"),
             months.getField("k").alias("distinct_months"))


def completeness(df: DataFrame, columns: tuple[str, ...] = ("country", "industry")) -> DataFrame:
    """Per column, NULL and blank counts and the missing share, over all
    rows (``scope = 'all'``) and per plan (``scope = 'plan'``, ``plan`` NULL
    for rows with no plan).

    One aggregation per plan; each of those few rows then counts once for its
    plan and once for the overall row, so the table is read once. An added zero
    row gives an empty table its overall row, as SQL's ROLLUP does.
    """
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"{c}__null"),
                 F.count_if(F.col(c) == "").alias(f"{c}__blank")]
    per_plan = df.groupBy("plan").agg(*aggs)
    measures = [a for a in per_plan.columns if a != "plan"]
    scoped = per_plan.withColumn("scope", F.explode(F.array(F.lit("plan"), F.lit("all"))))
    zero = df.sparkSession.range(1).select(
        F.lit(None).cast("string").alias("plan"), *[F.lit(0).cast("bigint").alias(m) for m in measures],
        F.lit("all").alias("scope"))
    g = (scoped.withColumn("plan", F.when(F.col("scope") == "plan", F.col("plan")))
         .unionByName(zero).groupBy("scope", "plan")
         .agg(*[F.sum(m).alias(m) for m in measures]))
    stack = ", ".join(f"'{c}', `{c}__null`, `{c}__blank`" for c in columns)
    long = g.selectExpr(
        "scope", "plan", "rows",
        f"stack({len(columns)}, {stack}) AS (column_name, null_count, blank_count)")
    return long.select(
        "scope", "plan", "column_name", "rows", "null_count", "blank_count",
        pct(F.col("null_count") + F.col("blank_count"), "rows").alias("missing_pct"),
    ).orderBy("scope", plan_rank().asc_nulls_last(), "column_name")


def free_plan_with_arr(df: DataFrame, plan: str = "Free") -> DataFrame:
    """Rows on ``plan`` that carry ARR > 0, with the plan the customer
    is on most often in their other rows (ties go to the higher tier) as the
    suggested plan; only rows where that suggestion differs are kept.

    Each flagged row is joined to its customer's per-plan counts - at most
    one row per known plan, so the join fans out by at most five. The counts
    are combined map-side before anything is shuffled by customer.
    """
    known = F.col("plan").isin(*PLAN_ORDER)
    flagged = (df.filter((F.col("plan") == plan) & (F.col("annual_recurring_revenue") > 0))
               .select("id", "month_date", "annual_recurring_revenue")
               .groupBy("id", "month_date", "annual_recurring_revenue")
               .agg(F.count("*").alias("copies")))
    counts = (df.filter(known).groupBy("id", "plan").agg(F.count("*").alias("n"))
              .withColumnRenamed("plan", "other_plan"))
    cand = flagged.join(counts, "id").withColumn(
        "n_other", F.col("n") - F.when(F.col("other_plan") == plan, F.col("copies")).otherwise(0))
    # Score = count * 8 + tier rank: max picks the most frequent plan, ties to the higher tier.
    score = F.col("n_other") * 8 + plan_rank("other_plan")
    best = (cand.filter(F.col("n_other") > 0)
            .groupBy("id", "month_date", "annual_recurring_revenue")
            .agg(F.max(score).alias("score")))
    rank = (F.col("score") % 8).cast("int")
    name = plan_from_rank(rank)
    return (best.select(F.col("id").alias("customer_id"), "month_date",
                        F.col("annual_recurring_revenue").cast("double").alias("arr"),
                        F.lit(plan).alias("plan"), name.alias("suggested_plan"))
            .filter(F.col("suggested_plan") != plan))


def duplicate_keys(df: DataFrame) -> DataFrame:
    """(customer, month) keys that occur more than once."""
    return (df.groupBy("id", "month_date").agg(F.count("*").alias("copies"))
            .filter(F.col("copies") > 1))


def month_gaps(df: DataFrame) -> DataFrame:
    """R04 / quirk K1: rows whose previous month present for the customer is
    more than one calendar month earlier. The LAG runs over distinct (customer,
    month) keys, so a customer has at most one row per month in the window."""
    keys = df.select("id", "month_date").distinct()
    prev = F.lag("month_date").over(Window.partitionBy("id").orderBy(asc_pg("month_date")))
    idx = lambda c: F.year(c) * 12 + F.month(c)
    g = keys.withColumn("prev_month", prev).filter(F.col("prev_month").isNotNull())
    missing = idx(F.col("month_date")) - idx(F.col("prev_month")) - 1
    return (g.select(F.col("id").alias("customer_id"), "month_date", "prev_month",
                     missing.cast("bigint").alias("missing_months"))
            .filter(F.col("missing_months") > 0))


def stopped_customers(df: DataFrame) -> DataFrame:
    """Quirk K2: customers whose rows end before the table's last month, so
    the churn report never counts them."""
    last = df.groupBy("id").agg(F.max("month_date").alias("last_month"))
    return (last.filter(F.col("last_month") < max_month(df))
            .select(F.col("id").alias("customer_id"), "last_month"))
