"""M04 kept up to date by a stream, late and repeated files included.

Each batch is reduced to one row per (customer, month) and stored under its number.
A customer whose months are all later than the last one known adds to the totals
from the batch and the status that its state holds. A customer with an earlier month
changes what its later months had added: its few months are read back from the
stored batches, and the difference between what they add now and what they added
before goes to the totals, both from one pass over those months. State and totals
are published together under the batch's number, so a batch that is replayed after
a failure counts once, and readers see the totals of one batch.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierscope.functions.expr import asc_pg
from tierscope.operators import growth
from tierscope.sources import published
from tierscope.sources.base_table import conform
from tierscope.sources.schema import BASE_SCHEMA
from tierscope.state import customer_state as cs

COUNTS = ["n_null", "n_false", "n_true"]
TOTALS = ["with_prev", "prev_active", "churned"]


def _history(root: str) -> str:
    return f"{root.rstrip('/')}_batches"


def _known(status: Column) -> Column:
    return F.when(status == 2, True).when(status == 1, False)


def _steps(months: DataFrame, before: Column | None = None) -> DataFrame:
    """``churn_steps`` of rows per (customer, month); ``before`` is the status number a
    customer had before its first row here."""
    line = Window.partitionBy(*cs.KEYS).orderBy(asc_pg("month_date"))
    prev = F.lag(cs.status()).over(line)
    if before is not None:
        prev = F.when(F.row_number().over(line) == 1, before).otherwise(prev)
    return growth.churn_steps(months.select("month_date", *COUNTS, _known(prev).alias("prev_last")))


def apply_batch(spark: SparkSession, batch: DataFrame, number: int, root: str, run: str = "",
                buckets: int = cs.BUCKETS) -> None:
    """Add the rows of batch ``number`` to the state and the totals under ``root``. A batch
    that has been applied isn't again; ``run`` names the source of the numbers."""
    label = published.current_label(spark, root)
    if label is not None:
        known, _, last = label.rpartition(".")
        if known != run:
            raise ValueError(f"{root} belongs to another run of the stream: use a new folder")
        if number <= int(last):
            return
    path = f"{_history(root)}/batch={number}"
    cs.per_month(batch).write.mode("overwrite").parquet(path)
    months = spark.read.parquet(path)
    version = published.current(spark, root)
    new_state = cs.state_of_months(months)
    if version is None:
        state, totals = new_state, growth.churn_totals(_steps(months))
    else:
        old = cs.state_at(spark, version)
        state = cs.merged(old, new_state)
        parts = [spark.read.parquet(f"{version}/totals"), *_changes(spark, root, months, new_state, old, number, buckets)]
        totals = parts[0]
        for p in parts[1:]:
            totals = totals.unionByName(p)
        totals = growth.churn_totals(totals)

    def write(folder: str) -> None:
        cs._write(spark, state, folder, buckets)
        totals.coalesce(1).write.parquet(f"{folder}/totals")  # one row per month

    published.publish(spark, root, write, f"{run}.{number}")


def _late(spark: SparkSession, root: str, new_state: DataFrame, state: DataFrame) -> DataFrame:
    """Customers of a batch that have a month no later than the last one known; kept in
    a folder of its own, because several steps ask for them."""
    first = F.col("first_month")  # NULL if the batch has only undated rows of the customer
    at = lambda no_month, month: F.struct(no_month.alias("no_month"), month.alias("month_date"))
    known = state.select(*cs.KEYS, F.col("last").alias("known"))
    path = f"{root.rstrip('/')}_late"
    (new_state.select(*cs.KEYS, "first_month").join(known, cs.KEYS)
     .where(at(first.isNull(), first) <= at(F.col("known.no_month"), F.col("known.month_date")))
     .select(*cs.KEYS).write.mode("overwrite").parquet(path))
    return spark.read.parquet(path)


def _difference(earlier: DataFrame, months: DataFrame, late: DataFrame) -> DataFrame:
    """What the months of ``late`` customers add now less what they added before: from
    one row per (customer, month) with the counts of earlier batches and of all."""
    before = [f"old_{c}" for c in COUNTS]
    zero = F.lit(0).cast("bigint")
    rows = earlier.select(*cs.KEYS, "month_date", *COUNTS, *[F.col(c).alias(b) for c, b in zip(COUNTS, before)]).unionByName(
        months.select(*cs.KEYS, "month_date", *COUNTS, *[zero.alias(b) for b in before]))
    both = rows.join(late, cs.KEYS, "left_semi").groupBy(*cs.KEYS, "month_date").agg(
        *[F.sum(c).alias(c) for c in COUNTS + before])
    line = Window.partitionBy(*cs.KEYS).orderBy(asc_pg("month_date"))
    had_rows = F.col("old_n_null") + F.col("old_n_false") + F.col("old_n_true") > 0
    prev = F.lag(cs.status()).over(line)
    # the month before among those that earlier batches had
    old_prev = F.last(F.when(had_rows, cs.status(*before[1:])), ignorenulls=True).over(
        line.rowsBetween(Window.unboundedPreceding, -1))
    steps = both.select("month_date", *COUNTS, *before, _known(prev).alias("prev_last"), _known(old_prev).alias("old_prev_last"))
    now, undone = growth.step_columns(*COUNTS, "prev_last"), growth.step_columns(*before, "old_prev_last")
    return steps.select("month_date", *[(now[c] - F.when(had_rows, undone[c]).otherwise(0)).alias(c) for c in TOTALS])


def _changes(spark: SparkSession, root: str, months: DataFrame, new_state: DataFrame, state: DataFrame, number: int,
             buckets: int) -> list[DataFrame]:
    mine = months.join(state.select(*cs.KEYS, "last"), cs.KEYS, "left")
    late = _late(spark, root, new_state, state)
    if late.isEmpty():  # history isn't opened
        return [growth.churn_totals(_steps(mine, F.col("last.status")))]
    late = late.repartition(buckets, *cs.KEYS)  # the other side follows
    timely = mine.join(late, cs.KEYS, "left_anti")
    earlier = spark.read.parquet(_history(root)).where(F.col("batch") < number)
    return [growth.churn_totals(_steps(timely, F.col("last.status"))),
            growth.churn_totals(_difference(earlier, months, late))]


def start_churn(spark: SparkSession, base_path: str, root: str, checkpoint_path: str,
                available_now: bool = False, interval: str = "10 minutes",
                max_files_per_trigger: int | None = None, buckets: int = cs.BUCKETS):
    """Start the stream; returns the ``StreamingQuery``. ``root`` and ``checkpoint_path``
    belong together: a new checkpoint needs a new root."""
    reader = spark.readStream.schema(BASE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    run = hashlib.sha1(checkpoint_path.rstrip("/").encode()).hexdigest()[:12]

    def on_batch(batch: DataFrame, number: int) -> None:
        apply_batch(batch.sparkSession, batch, number, root, run, buckets)

    writer = (conform(reader.parquet(base_path)).writeStream.foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint_path).queryName("tierscope_churn"))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def read_churn(spark: SparkSession, root: str) -> DataFrame:
    """M04 as of the last batch."""
    return growth.churn_rates(spark.read.parquet(f"{published.current(spark, root)}/totals"))


def read_customers(spark: SparkSession, root: str) -> DataFrame:
    """The customer state as of the last batch."""
    return cs.read_state(spark, root)
