"""Derive ``customer_monthly_metrics`` from the TPC-H-style test tables.

The reference reads a PostgreSQL table that is not part of the test data,
so the base table is derived deterministically from ``customer``,
``nation``, ``orders`` and ``lineitem`` (rules in FIXTURES.md section 3).
The derivation is a Spark job whose work grows with those tables:

* orders and shipped line items are pre-aggregated per (customer, month)
  before anything is keyed by customer, so a customer holding a large share
  of all orders costs one partial-aggregate row per map task, not a hot
  shuffle partition;
* the customer-by-month panel is generated per customer with
  ``sequence`` + ``explode`` (no cross or range join); each customer gets at
  most one row per calendar month; it meets the fact aggregates in a union
  shuffled once by customer, and the (customer, month) merge and both
  per-customer windows reuse that one partitioning;
* the calendar (distinct month-ends of the order dates) is broadcast: its
  size is bounded by the months of history, not by data volume, and a shuffle
  join on its month number would concentrate the panel on a few dozen keys;
* the trailing-12-month sums and the per-customer first paid month are
  windows partitioned by customer, whose partitions hold at most one row per
  calendar month each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierscope.sources.schema import COLUMNS, MONEY

# Fixed values of the fixture rules (FIXTURES.md section 3). They define the
# test data, so the DuckDB oracle uses the very same numbers.
TRAILING_ROWS = 12          # rule 5: 11 preceding rows to the current one
E28_DAY_WINDOW = 28         # rule 4: shipped within 28 days of month end
GAP_MODULUS = 17            # rule 11

# Sizes of a task of the two large shuffles, whatever the session's number of shuffle
# partitions (which AQE may join, but never splits for the windows).
LINES_PER_TASK = 500_000
CUSTOMERS_PER_TASK = 10_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tasks(df: DataFrame, rows_per_task: int) -> int:
    """Number of tasks that grows with the rows of a stored table (counted from the
    footers of its files), at least one for each core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def derive_base_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lazy DataFrame with the schema of ``BASE_SCHEMA``."""
    orders = _read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey",
        F.last_day(F.to_date("o_orderdate")).alias("month_date"),
        F.col("o_totalprice").cast(MONEY).alias("price"),
    )
    lineitem = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_quantity").cast("bigint").alias("qty"),
        F.to_date("l_shipdate").alias("ship_date"),
    )
    customer = _read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), "c_nationkey", "c_mktsegment")
    nation = _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")

    # Orders and shipped quantity per (customer, month), pre-aggregated
    # map-side before anything is keyed by customer.
    n_lines = _tasks(lineitem, LINES_PER_TASK)
    n_customers = _tasks(customer, CUSTOMERS_PER_TASK)
    oagg = (orders.groupBy(F.col("o_custkey").alias("id"), "month_date")
            .agg(F.count("*").alias("n_orders"), F.sum("price").alias("rev")))
    buyers = orders.select("o_orderkey", "o_custkey").repartition(n_lines, "o_orderkey")
    shipped = (lineitem.repartition(n_lines, "l_orderkey").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
               .select(F.col("o_custkey").alias("id"), "qty", "ship_date",
                       F.last_day("ship_date").alias("month_date")))
    sagg = (shipped.groupBy("id", "month_date").agg(
        F.sum(F.when(F.dayofmonth("month_date") - F.dayofmonth("ship_date") < E28_DAY_WINDOW,
                     F.col("qty")).otherwise(0)).alias("e28"),
        F.sum(F.when(F.col("ship_date") == F.col("month_date"), F.col("qty"))
              .otherwise(0)).alias("e1")))

    # Rule 1: calendar of distinct month-ends of the orders, numbered in date
    # order. Taken from the orders aggregate (same months, far fewer rows);
    # the numbering window sees one row per month.
    months = oagg.select("month_date").distinct()
    cal = months.withColumn(
        "idx", (F.row_number().over(Window.orderBy("month_date")) - 1).cast("bigint"))
    n_months = cal.select(F.count("*")).scalar()
    # The calendar is broadcast on purpose: its size is bounded by the months
    # the order dates span (12 rows per year of history), whatever the data
    # volume. A shuffle join on ``idx`` would instead send every customer-month
    # of one calendar month to one task (a few dozen keys for the whole panel).
    cal_b = F.broadcast(cal)

    # Rules 2-3: customer attributes (joined back by customer at the end).
    id_ = F.col("id")
    entry = cal_b.select(F.col("idx").alias("entry_idx"),
                       F.trunc("month_date", "month").alias("entry_month"))
    # nation is a fixed 25-row dimension at every scale factor: broadcast
    # rather than shuffle all customers onto 25 join keys.
    cust = (customer.join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "left")
            .select("id", "c_nationkey", (id_ % n_months).alias("entry_idx"),
                    F.when(id_ % 4 != 0, None).when(id_ % 16 == 12, "")
                     .otherwise(F.col("n_name")).alias("country"),
                    F.when(id_ % 4 != 0, None).when(id_ % 16 == 8, "")
                     .otherwise(F.col("c_mktsegment")).alias("industry"))
            .join(entry, "entry_idx")
            .withColumn("account_created_date",
                        F.when(id_ % 50 == 7, None)
                         .otherwise(F.date_add("entry_month", (id_ % 31).cast("int"))))
            .drop("entry_month"))

    # Rule 4: panel = every calendar month from the entry month on, as
    # (customer, month) skeleton rows, merged with the two fact aggregates by
    # one shuffle on customer: union, repartition by id, then the (id, month)
    # aggregate and the per-customer windows all reuse that partitioning. Each
    # customer has at most three rows per calendar month at this point.
    zero_money = F.lit(0).cast(MONEY)
    skeleton = (customer.select("id")
                .withColumn("entry_idx", id_ % n_months)
                .withColumn("idx", F.explode(F.sequence(F.col("entry_idx"), n_months - 1)))
                .join(cal_b, "idx")
                .select("id", "month_date", "idx", "entry_idx", F.lit(1).alias("in_panel"),
                        F.lit(0).cast("bigint").alias("n_orders"), zero_money.alias("rev"),
                        F.lit(0).cast("bigint").alias("e28"), F.lit(0).cast("bigint").alias("e1")))
    no_idx = F.lit(None).cast("bigint")
    facts_o = oagg.select("id", "month_date", no_idx.alias("idx"), no_idx.alias("entry_idx"),
                          F.lit(0).alias("in_panel"), "n_orders", "rev",
                          F.lit(0).cast("bigint").alias("e28"),
                          F.lit(0).cast("bigint").alias("e1"))
    facts_s = sagg.select("id", "month_date", no_idx.alias("idx"), no_idx.alias("entry_idx"),
                          F.lit(0).alias("in_panel"), F.lit(0).cast("bigint").alias("n_orders"),
                          zero_money.alias("rev"), "e28", "e1")
    panel = (skeleton.unionByName(facts_o).unionByName(facts_s)
             .repartition(n_customers, "id")
             .groupBy("id", "month_date")
             .agg(F.max("in_panel").alias("in_panel"), F.max("idx").alias("idx"),
                  F.max("entry_idx").alias("entry_idx"), F.sum("n_orders").alias("n_orders"),
                  F.sum("rev").alias("rev"), F.sum("e28").alias("e28"),
                  F.sum("e1").alias("e1"))
             .filter(F.col("in_panel") == 1))   # facts outside the panel drop (left join)

    # Rule 5: trailing 12 rows per customer, before the gaps of rule 11.
    trail = Window.partitionBy("id").orderBy("idx").rowsBetween(-(TRAILING_ROWS - 1), 0)
    panel = (panel.withColumn("n12", F.sum("n_orders").over(trail))
             .withColumn("rev12", F.sum("rev").over(trail))
             .join(cust.drop("entry_idx"), "id"))

    idx = F.col("idx")
    n12 = F.col("n12")
    zero_day = (id_ + idx) % 4 == 0
    plan = (F.when(id_ % 97 == 5, F.lit(None).cast("string"))
            .when((id_ % 9 == 4) & (idx - F.col("entry_idx") <= 1), "Top")
            .when((id_ % 100 == 19) & (idx % 20 == 6), "Free")
            .when(n12 == 0, F.when(id_ % 3 == 0, "Trial").otherwise("Free"))
            .when(n12 == 1, "Low")
            .when(n12 == 2, "Middle")
            .otherwise("Top"))
    is_active = (F.when((id_ % 61 == 3) & (idx % 10 == 0), F.lit(None).cast("boolean"))
                 .when(n12 > 0, (id_ + idx) % 23 != 0)
                 .otherwise((id_ + idx) % 5 != 0))
    arr = (F.when((n12 == 0) | (F.col("c_nationkey") == 24), F.lit(None).cast(MONEY))
           .otherwise(F.col("rev12").cast(MONEY)))
    events_28d = F.when(zero_day, F.lit(0).cast("bigint")).otherwise(
        4 * F.col("e28") + F.when(id_ % 10 == 0, 700 + 10 * (idx % 7))
        .otherwise((7 * id_ + idx) % 60)).cast("bigint")
    events_daily = F.when(zero_day, F.lit(0).cast("bigint")).otherwise(
        4 * F.col("e1") + id_ % 6).cast("bigint")

    rows = (panel.filter((3 * id_ + idx) % GAP_MODULUS != 0)  # rule 11
            .select("id", "month_date",
                    plan.alias("plan"), is_active.alias("is_active"),
                    arr.alias("annual_recurring_revenue"),
                    events_daily.alias("events_daily"), events_28d.alias("events_28d"),
                    "country", "industry", "account_created_date"))
    # Rule 12: same partitioning (by id) as the trailing window above.
    first_paid = F.min(F.when(F.col("annual_recurring_revenue") > 0, F.col("month_date"))) \
        .over(Window.partitionBy("id"))
    return rows.withColumn("first_paid_date", first_paid).select(*COLUMNS)
