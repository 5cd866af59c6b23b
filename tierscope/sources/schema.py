"""Schema of the one input table, ``customer_monthly_metrics``.

Grain: one row per (customer ``id``, ``month_date``). The grain is not
enforced by the source; operators never assume it (distinct counts stay
exact) and ``tierscope.operators.quality.duplicate_keys`` reports violations.
"""

from pyspark.sql import types as T

TABLE_NAME = "customer_monthly_metrics"

MONEY = T.DecimalType(18, 2)

BASE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("month_date", T.DateType(), False),
    T.StructField("plan", T.StringType(), True),
    T.StructField("is_active", T.BooleanType(), True),
    T.StructField("annual_recurring_revenue", MONEY, True),
    T.StructField("events_daily", T.LongType(), True),
    T.StructField("events_28d", T.LongType(), True),
    T.StructField("country", T.StringType(), True),
    T.StructField("industry", T.StringType(), True),
    T.StructField("account_created_date", T.DateType(), True),
    T.StructField("first_paid_date", T.DateType(), True),
])

COLUMNS = [f.name for f in BASE_SCHEMA.fields]
