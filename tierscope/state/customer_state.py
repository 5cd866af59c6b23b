"""One row per customer, kept up to date from new rows only.

M05, M09, M14 and the stopped customers of R04 look at each customer's whole
history. What they need of it merges: the first month, the first paid month, the
row that counts as the sign-up, the last month and its status. The state table
holds that, bucketed and sorted by customer. An update aggregates the new rows,
shuffles only those, and joins them to the state where it lies (the state's side
has no exchange), in a new published version; so its cost is the new rows plus
one sequential pass over one row per customer.

Everything merges by minimum or maximum, in any order: late and repeated rows are
as good as timely ones. Corrections that take rows away don't merge; for those
customers the state is made anew (``replace_customers``).

A NULL id is a customer, as in ``GROUP BY``: the join key is the id with 0 for
NULL, and a flag.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.functions.expr import date_of_day_number, day_number, sign_up_code, sign_up_of
from tierscope.operators import growth, revenue
from tierscope.operators.latest import max_month
from tierscope.sources import published

BUCKETS = 64
KEYS = ["customer", "no_id"]


def keyed(df: DataFrame) -> DataFrame:
    """``df`` with the join key of its ``id``."""
    return df.select(F.coalesce("id", F.lit(0).cast("bigint")).alias("customer"), F.col("id").isNull().alias("no_id"), "*")


def status(n_false: str = "n_false", n_true: str = "n_true") -> Column:
    """Status that a month's rows of one customer end with, as a number in the order
    NULL, FALSE, TRUE (the order in which M04 takes them)."""
    return F.when(F.col(n_true) > 0, 2).when(F.col(n_false) > 0, 1).otherwise(0)


def _last() -> Column:
    """Month (NULL last, as PostgreSQL orders it) and status of a month's rows as one
    number, whose maximum is a hash aggregate."""
    month = F.when(F.col("month_date").isNull(), F.lit(1 << 32)).otherwise(day_number("month_date"))
    return month * 4 + status()


def _last_of(code: str) -> Column:
    month = F.shiftright(code, 2)
    unknown = month == F.lit(1 << 32)
    return F.struct(unknown.alias("no_month"), F.when(~unknown, date_of_day_number(month)).alias("month_date"),
                    F.col(code).bitwiseAND(F.lit(3).cast("bigint")).cast("int").alias("status"))


def per_month(rows: DataFrame) -> DataFrame:
    """What the state needs of each (customer, month), combined map-side, with the
    numbers of NULL, FALSE and TRUE rows that M04 counts."""
    return keyed(rows).groupBy(*KEYS, "month_date").agg(
        F.count_if(F.col("is_active").isNull()).alias("n_null"), F.count_if(~F.col("is_active")).alias("n_false"),
        F.count_if("is_active").alias("n_true"), F.min(sign_up_code()).alias("sign_up"),
        F.bool_or(F.col("annual_recurring_revenue") > 0).alias("paid"))


def state_of(rows: DataFrame) -> DataFrame:
    """The state of the customers of ``rows``, from these rows alone."""
    return state_of_months(per_month(rows))


def state_of_months(months: DataFrame) -> DataFrame:
    """The state from ``per_month`` rows (several of one customer and month are merged)."""
    return months.groupBy(*KEYS).agg(
        F.min("month_date").alias("first_month"),
        F.min(F.when(F.col("paid"), F.col("month_date"))).alias("first_paid_month"),
        F.min("sign_up").alias("sign_up"), F.max("month_date").alias("last_month"), F.max(_last()).alias("last"),
        F.sum(F.col("n_null") + F.col("n_false") + F.col("n_true")).alias("n_rows")).withColumns(
        {"sign_up": sign_up_of("sign_up"), "last": _last_of("last")})


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two states as one: a full outer join by customer, so a bucketed side stays
    where it is."""
    x, y = a.alias("x"), b.alias("y")
    least = lambda c: F.least(F.col(f"x.{c}"), F.col(f"y.{c}"))  # NULLs are skipped
    return x.join(y, KEYS, "full_outer").select(
        *KEYS, *[least(c).alias(c) for c in ("first_month", "first_paid_month", "sign_up")],
        *[F.greatest(f"x.{c}", f"y.{c}").alias(c) for c in ("last_month", "last")],
        (F.coalesce("x.n_rows", F.lit(0)) + F.coalesce("y.n_rows", F.lit(0))).alias("n_rows"))


def _table(path: str) -> str:
    return f"customer_state_{hashlib.sha1(path.encode()).hexdigest()[:16]}"


def _write(spark: SparkSession, state: DataFrame, path: str, buckets: int) -> None:
    # dealt as the buckets are: one file each, however many tasks have made the state
    (state.repartition(buckets, *KEYS).write.format("parquet").bucketBy(buckets, *KEYS).sortBy(*KEYS)
     .option("path", f"{path}/state-{buckets}").mode("overwrite").saveAsTable(_table(f"{path}/state-{buckets}")))


def state_at(spark: SparkSession, version: str) -> DataFrame:
    """The state table in a published folder. Its buckets are known to the session's
    catalog, or entered there from the folder."""
    fs, p = published._fs(spark, version)
    name = next(st.getPath().getName() for st in fs.listStatus(p) if st.getPath().getName().startswith("state-"))
    path, table = f"{version}/{name}", _table(f"{version}/{name}")
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(KEYS)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                  f"INTO {int(name.split('-')[1])} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def read_state(spark: SparkSession, root: str) -> DataFrame | None:
    """The state last published under ``root``; None before the first update."""
    version = published.current(spark, root)
    return None if version is None else state_at(spark, version)


def update_state(spark: SparkSession, root: str, new_rows: DataFrame, buckets: int = BUCKETS,
                 label: str = "") -> DataFrame:
    """Merge ``new_rows`` (rows that no earlier update has seen) into the state under
    ``root`` and publish it. An update labelled like the last one isn't applied again,
    so a batch that is replayed after a failure counts once."""
    if label and published.current_label(spark, root) == label:
        return read_state(spark, root)
    old, new = read_state(spark, root), state_of(new_rows)
    state = new if old is None else merged(old, new)
    return state_at(spark, published.publish(spark, root, lambda path: _write(spark, state, path, buckets), label))


def replace_customers(spark: SparkSession, root: str, rows: DataFrame, ids: DataFrame,
                      buckets: int = BUCKETS, label: str = "") -> DataFrame:
    """Make the state of the customers ``ids`` (one column, id) anew from ``rows``, the
    corrected table; customers without a row left lose theirs."""
    if label and published.current_label(spark, root) == label:
        return read_state(spark, root)
    wanted = keyed(ids.select("id").distinct()).select(*KEYS)
    fresh = state_of(keyed(rows).join(wanted, KEYS, "left_semi").drop(*KEYS))
    state = read_state(spark, root).join(wanted, KEYS, "left_anti").unionByName(fresh)
    return state_at(spark, published.publish(spark, root, lambda path: _write(spark, state, path, buckets), label))


def _id() -> Column:
    return F.when(~F.col("no_id"), F.col("customer"))


def new_customers(state: DataFrame) -> DataFrame:
    """M05 from the state: no row of the base table is read."""
    return growth.signups(state.where("sign_up is not null").select(
        _id().alias("id"), "sign_up.account_created_date", "sign_up.first_paid_date"))


def conversion_funnel(state: DataFrame, require_free_start: bool = False) -> DataFrame:
    """M09 from the state."""
    return growth.funnel(state.select("first_month", "first_paid_month"), require_free_start)


def new_customers_of_note(base: DataFrame, state: DataFrame, **options) -> DataFrame:
    """First months come from the state (joined where it lies), and the base table
    is read in the last months (and undated rows) only. Options as
    ``revenue.new_customers_of_note``."""
    def with_first_seen(rows, cutoff):
        first = state.where((F.col("first_month") >= cutoff) & ~F.col("no_id")).select(
            *KEYS, F.col("first_month").alias("first_seen"))
        return keyed(rows).join(first, KEYS).drop(*KEYS)

    return revenue.new_customers_of_note(base, with_first_seen=with_first_seen, **options)


def stopped_customers(base: DataFrame, state: DataFrame) -> DataFrame:
    """R04's stopped customers from the state and the month list."""
    return state.where(F.col("last_month") < max_month(base)).select(_id().alias("customer_id"), "last_month")
