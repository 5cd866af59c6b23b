"""Queries answered from kept state instead of history.

Each folder's base table is fed in three appends that arrive out of order (the last
third of the months, the first, the middle one) to the customer state, the churn
stream's batches and the month bitmaps; the queries read what those have become.
Their SQL is the SQL of the reports over the whole table.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.functions.expr import from_cents
from tierscope.operators import cube
from tierscope.operators.latest import months_of
from tierscope.session import scratch_dir
from tierscope.sources import changes
from tierscope.sources.base_table import _fingerprint, load_base_table
from tierscope.state import customer_state, month_bitmaps, usage_histograms
from tierscope.streaming import churn

ROWS_PER_BUCKET = 1_000_000  # of the whole table, so that a bucket's task doesn't grow with it

_FED: dict = {}
_LOCK = threading.Lock()


def appends(base: DataFrame) -> list[DataFrame]:
    """The table in three appends by month, out of order; undated rows come last."""
    months = sorted(r[0] for r in months_of(base).where("month_date IS NOT NULL").select("month_date").collect())
    third = len(months) // 3
    cuts = [months[2 * third:], months[:third], months[third:2 * third]]
    parts = [base.where(F.col("month_date").isin(c)) for c in cuts if c]
    return [*parts, base.where("month_date IS NULL")]


def feed(spark: SparkSession, sf_dir: str) -> str:
    """Folder with the kept state of ``sf_dir``'s base table, fed once per application."""
    with _LOCK:
        key = (spark.sparkContext.applicationId, _fingerprint(spark, sf_dir))
        if key not in _FED:
            root = f"{scratch_dir(spark).rstrip('/')}/tierscope/kept-{key[1]}-{uuid.uuid4().hex[:8]}"
            base = load_base_table(spark, sf_dir)
            n_rows = months_of(base).agg(F.sum("rows")).first()[0] or 0
            buckets = max(8, -(-n_rows // ROWS_PER_BUCKET))
            for k, part in enumerate(appends(base)):
                churn.apply_batch(spark, part, k, f"{root}/churn", "feed", buckets)
                usage_histograms.append(spark, f"{root}/bitmaps", part, f"part{k}")
            _FED[key] = root
        return _FED[key]


def customer_rows(state: DataFrame) -> DataFrame:
    return state.select(
        F.when(~F.col("no_id"), F.col("customer")).alias("customer_id"), "first_month", "first_paid_month", "last_month",
        F.col("sign_up.account_created_date").alias("signup_date"),
        F.col("sign_up.first_paid_date").alias("signup_first_paid"), "n_rows")


def cube_rows(found: DataFrame) -> DataFrame:
    return found.withColumns({"arr": from_cents("arr"), "ev": F.col("ev").cast("bigint")})


def _state(spark, sf_dir) -> DataFrame:
    return customer_state.read_state(spark, f"{feed(spark, sf_dir)}/churn")


def _cube(spark, sf_dir) -> DataFrame:
    return cube.month_cube(load_base_table(spark, sf_dir))


def _bitmaps(spark, sf_dir) -> DataFrame:
    return month_bitmaps.as_cube(spark, f"{feed(spark, sf_dir)}/bitmaps")


def corrected(base: DataFrame) -> DataFrame:
    """A snapshot with late corrections: rows without a plan are taken back, revenue of
    Top rows is a dollar higher, an unknown status becomes inactive, and rows of Low
    customers in an industry come once more."""
    fixed = base.where("plan IS NOT NULL").withColumns({
        "annual_recurring_revenue": F.when(F.col("plan") == "Top", F.col("annual_recurring_revenue") + 1).otherwise(
            F.col("annual_recurring_revenue")),
        "is_active": F.coalesce("is_active", F.lit(False))})
    return fixed.unionByName(fixed.where("plan = 'Low' AND industry <> ''"))


def _changes(spark, sf_dir) -> DataFrame:
    base = load_base_table(spark, sf_dir)
    return changes.by_month(changes.differences(base, corrected(base)))


# Name: (query, name of the report over all history with the same result, or None)
MAINTAINED: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "s01_customer_state": (lambda s, d: customer_rows(_state(s, d)), None),
    "m05_from_state": (lambda s, d: customer_state.new_customers(_state(s, d)), "m05_new_customers"),
    "m09_from_state": (lambda s, d: customer_state.conversion_funnel(_state(s, d)), "m09_conversion_funnel"),
    "m14_from_state": (lambda s, d: customer_state.new_customers_of_note(load_base_table(s, d), _state(s, d)),
                       "m14_new_customers_of_note"),
    "r04_stopped_from_state": (lambda s, d: customer_state.stopped_customers(load_base_table(s, d), _state(s, d)),
                               "r04_stopped_customers"),
    "m04_from_batches": (lambda s, d: churn.read_churn(s, f"{feed(s, d)}/churn"), "m04_churn_metrics"),
    "m01_from_bitmaps": (lambda s, d: cube.monthly_metrics(_bitmaps(s, d)), "m01_monthly_metrics"),
    "m03_from_bitmaps": (lambda s, d: cube.plan_distribution(_bitmaps(s, d)), "m03_plan_distribution"),
    "m06_from_histograms": (lambda s, d: usage_histograms.usage_by_plan(s, f"{feed(s, d)}/bitmaps"), "m06_usage_by_plan"),
    "m11_from_bitmaps": (lambda s, d: cube.mau_metrics(_bitmaps(s, d)), "m11_mau_metrics"),
    "x01_corrections_by_month": (_changes, None),
    "c01_month_cube": (lambda s, d: cube_rows(_cube(s, d)), None),
    "m02_from_cube": (lambda s, d: cube.arr_by_plan(_cube(s, d)), "m02_arr_by_plan"),
    "m07_from_cube": (lambda s, d: cube.breakdown_latest(_cube(s, d), "country"), "m07_revenue_by_geography"),
    "m10_from_cube": (lambda s, d: cube.latest_snapshot(_cube(s, d)), "m10_latest_snapshot"),
    "m12_from_cube": (lambda s, d: cube.inactive_rate_current(_cube(s, d)), "m12_inactive_rate_current"),
    "m15_from_cube": (lambda s, d: cube.usage_trends_by_plan(_cube(s, d)), "m15_usage_trends_by_plan"),
}

_SCOPES = [("month", "NULL", "true"), ("plan", "plan", "true"),
           *((c, c, f"{c} IS NOT NULL AND {c} <> '' AND month_date = (SELECT max(month_date) FROM cmm)")
             for c in ("country", "industry"))]
BODIES = {
    "s01_customer_state": """
SELECT id AS customer_id, min(month_date) AS first_month,
       min(CASE WHEN annual_recurring_revenue > 0 THEN month_date END) AS first_paid_month, max(month_date) AS last_month,
       first(account_created_date ORDER BY month_date NULLS LAST, account_created_date, first_paid_date NULLS FIRST)
         FILTER (account_created_date IS NOT NULL) AS signup_date,
       first(first_paid_date ORDER BY month_date NULLS LAST, account_created_date, first_paid_date NULLS FIRST)
         FILTER (account_created_date IS NOT NULL) AS signup_first_paid,
       count(*) AS n_rows
FROM cmm GROUP BY id""",
    "x01_corrections_by_month": """
, fixed AS (
  SELECT * REPLACE (CAST(CASE WHEN plan = 'Top' THEN annual_recurring_revenue + 1 ELSE annual_recurring_revenue END
                         AS DECIMAL(18,2)) AS annual_recurring_revenue, coalesce(is_active, false) AS is_active)
  FROM cmm WHERE plan IS NOT NULL),
now AS (SELECT * FROM fixed UNION ALL SELECT * FROM fixed WHERE plan = 'Low' AND industry <> ''),
gone AS (SELECT id, month_date, count(*) AS n FROM (SELECT * FROM cmm EXCEPT ALL SELECT * FROM now) GROUP BY ALL),
come AS (SELECT id, month_date, count(*) AS n FROM (SELECT * FROM now EXCEPT ALL SELECT * FROM cmm) GROUP BY ALL),
kinds AS (
  SELECT coalesce(g.month_date, c.month_date) AS month_date, coalesce(g.n, 0) AS removed, coalesce(c.n, 0) AS added,
         CASE WHEN NOT EXISTS (SELECT 1 FROM cmm o WHERE o.id = coalesce(g.id, c.id)
                               AND o.month_date = coalesce(g.month_date, c.month_date)) THEN 'inserted'
              WHEN NOT EXISTS (SELECT 1 FROM now o WHERE o.id = coalesce(g.id, c.id)
                               AND o.month_date = coalesce(g.month_date, c.month_date)) THEN 'deleted'
              ELSE 'changed' END AS kind
  FROM gone g FULL JOIN come c ON c.id = g.id AND c.month_date = g.month_date)
SELECT month_date, kind, count(*) AS keys, CAST(sum(removed) AS BIGINT) AS removed, CAST(sum(added) AS BIGINT) AS added
FROM kinds GROUP BY month_date, kind""",
    "c01_month_cube": " UNION ALL ".join(f"""
SELECT month_date, '{scope}' AS scope, {value} AS value,
       count(DISTINCT id) FILTER (is_active) AS active_customers, count(DISTINCT id) AS total_customers,
       count(DISTINCT id) FILTER (events_28d > 0) AS used_customers, count(*) AS n_rows,
       count(*) FILTER (is_active) AS n_active, count(*) FILTER (is_active AND events_28d = 0) AS n_idle,
       count(annual_recurring_revenue) FILTER (is_active) AS arr_n, count(events_28d) FILTER (is_active) AS ev_n,
       CAST(sum(annual_recurring_revenue) FILTER (is_active) AS DOUBLE) AS arr,
       CAST(sum(events_28d) FILTER (is_active) AS BIGINT) AS ev
FROM cmm WHERE {where} GROUP BY ALL""" for scope, value, where in _SCOPES),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in MAINTAINED.items()}


def oracle_sql() -> dict[str, str]:
    from tierscope.plans import oracle
    return {name: oracle.with_base(BODIES[name]) if same is None else oracle.M[same]
            for name, (_, same) in MAINTAINED.items()}


__all__ = ["MAINTAINED", "appends", "feed", "oracle_sql", "queries"]
