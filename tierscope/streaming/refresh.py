"""Incremental refresh of the per-month reports as new data lands.

The reference keeps results fresh with a 600-second in-process cache that
re-runs every query. On Spark the same freshness comes from a Structured
Streaming query over the base table's folder: each micro-batch holds the
newly written files, the months they touch are recomputed from the whole
table (those month partitions only), and the report rows of those months are
overwritten in place.

Only reports whose rows depend on a single month are maintained this way
(M01 monthly metrics, M02 ARR by plan, M03 plan mix, M11 MAU, M15 usage
trends); reports that look across months (churn, cohorts, top lists of the
latest month) are cheap to re-run as batch queries on the pruned months.

A touched month that has no result rows any more is cleared, so the reports
always equal the batch operators over the table. Replaying a batch after a
failure recomputes the same months from the same table and replaces the same
partitions, without any state of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.operators import cube, revenue, usage
from tierscope.session import scratch_dir
from tierscope.sources import changes, published
from tierscope.sources.base_table import conform, read_base_table
from tierscope.sources.schema import BASE_SCHEMA
from tierscope.state import customer_state

MONTH_LOCAL_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "monthly_metrics": revenue.monthly_metrics,
    "arr_by_plan": revenue.arr_by_plan,
    "plan_distribution": revenue.plan_distribution,
    "mau_metrics": usage.mau_metrics,
    "usage_trends_by_plan": usage.usage_trends_by_plan,
}


PUBLISHED_REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "monthly_metrics": cube.monthly_metrics,
    "arr_by_plan": cube.arr_by_plan,
    "plan_distribution": cube.plan_distribution,
    "revenue_by_geography": lambda c: cube.breakdown_latest(c, "country"),
    "industry_breakdown": lambda c: cube.breakdown_latest(c, "industry"),
    "latest_snapshot": cube.latest_snapshot,
    "mau_metrics": cube.mau_metrics,
    "inactive_rate_current": cube.inactive_rate_current,
    "usage_trends_by_plan": cube.usage_trends_by_plan,
}


def refresh_months(spark: SparkSession, base_path: str, out_path: str, months: DataFrame,
                   reports: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> None:
    """Recompute ``reports`` for the months in ``months`` (one column,
    ``month_date``) and replace those month partitions under ``out_path``.

    The touched months are a short list of literals (one value per month, so its
    size is bounded by the calendar), which makes them a partition filter: other
    months aren't read. Their rows are kept for all reports, so the table is read
    once. A touched month without result rows loses its partition.
    """
    reports = reports or MONTH_LOCAL_REPORTS
    touched = [r[0] for r in months.select("month_date").distinct().collect()]
    if not touched:
        return
    rows = touched_rows(spark, base_path, touched).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name, op in reports.items():
            path = f"{out_path.rstrip('/')}/{name}"
            result = op(rows).persist()  # a few rows per month, used twice
            (result.write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic")
             .partitionBy("month_date").parquet(path))
            _clear_empty(spark, path, touched, result)
            result.unpersist()
    finally:
        rows.unpersist()


def refresh_published(spark: SparkSession, base_path: str, root: str, months: DataFrame) -> str | None:
    """Recompute the cube of the touched months (one scan of those months), put it with the
    other months' of the version before, and publish it with every report over it, each
    computed once. Readers (``read_published``) see all reports of one version; a refresh
    that dies publishes nothing, and doing it again gives the same result."""
    touched = [r[0] for r in months.select("month_date").distinct().collect()]
    if not touched:
        return published.current(spark, root)
    before = published.current(spark, root)
    found = cube.month_cube(touched_rows(spark, base_path, touched), all_months=True)
    if before is not None:
        list_ = spark.createDataFrame([(m,) for m in touched], "t date")  # one row per month
        old = spark.read.parquet(f"{before}/cube")
        found = old.join(list_, old["month_date"].eqNullSafe(list_["t"]), "left_anti").unionByName(found)

    def write(folder: str) -> None:
        # one row per month and value
        found.coalesce(1).write.parquet(f"{folder}/cube")
        kept = spark.read.parquet(f"{folder}/cube")
        for name, op in PUBLISHED_REPORTS.items():
            op(kept).coalesce(1).write.parquet(f"{folder}/{name}")

    return published.publish(spark, root, write)


def refresh_corrected(spark: SparkSession, old: DataFrame, new: DataFrame, new_path: str, reports_root: str,
                      state_root: str | None = None) -> DataFrame:
    """Bring published reports (and the customer state) from snapshot ``old`` to the
    corrected snapshot ``new``, which is stored at ``new_path``: only the months and the
    customers that differ are computed again. Returns the differences."""
    folder = f"{scratch_dir(spark).rstrip('/')}/tierscope/changes-{uuid.uuid4().hex}"
    changes.differences(old, new).write.parquet(folder)
    found = spark.read.parquet(folder)
    refresh_published(spark, new_path, reports_root, changes.touched_months(found))
    if state_root is not None and not found.isEmpty():
        customer_state.replace_customers(spark, state_root, new, changes.touched_customers(found))
    return found


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A report of the version that is current now."""
    return spark.read.parquet(f"{published.current(spark, root)}/{name}")


def touched_rows(spark: SparkSession, base_path: str, touched: list) -> DataFrame:
    """The base table's rows of the given months (None: rows without a month)."""
    month = F.col("month_date")
    dated = [m for m in touched if m is not None]
    wanted = month.isin(dated) if dated else F.lit(False)
    if len(dated) < len(touched):
        wanted = wanted | month.isNull()
    return read_base_table(spark, base_path).filter(wanted)


def _clear_empty(spark: SparkSession, path: str, touched: list, result: DataFrame) -> None:
    """Dynamic overwrite replaces only partitions that have new rows; drop the
    touched months that have none."""
    kept = {r[0] for r in result.select("month_date").distinct().collect()}
    jvm = spark.sparkContext._jvm
    for m in touched:
        if m not in kept:
            value = "__HIVE_DEFAULT_PARTITION__" if m is None else str(m)
            p = jvm.org.apache.hadoop.fs.Path(f"{path}/month_date={value}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def start_refresh(spark: SparkSession, base_path: str, out_path: str, checkpoint_path: str,
                  reports: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
                  available_now: bool = False, interval: str = "10 minutes",
                  max_files_per_trigger: int | None = None, publish: bool = False):
    """Start the streaming refresh; returns the ``StreamingQuery``. With ``publish``
    every batch publishes the reports of ``PUBLISHED_REPORTS`` as one version.

    ``checkpoint_path`` must be on shared storage (the stream's offsets and
    committed batches live there). ``available_now=True`` processes what is
    there and stops (a catch-up run); otherwise it triggers every
    ``interval``.
    """
    reader = spark.readStream.schema(BASE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    new_rows = conform(reader.parquet(base_path))

    def on_batch(batch: DataFrame, epoch_id: int) -> None:
        months = batch.select("month_date").distinct()
        if publish:
            refresh_published(batch.sparkSession, base_path, out_path, months)
            return
        refresh_months(batch.sparkSession, base_path, out_path, months, reports)

    writer = (new_rows.select("month_date").writeStream
              .foreachBatch(on_batch)
              .option("checkpointLocation", checkpoint_path)
              .queryName("tierscope_refresh"))
    writer = writer.trigger(availableNow=True) if available_now \
        else writer.trigger(processingTime=interval)
    return writer.start()


def read_report(spark: SparkSession, out_path: str, name: str) -> DataFrame:
    """A maintained report, in the column order of its batch operator."""
    df = spark.read.parquet(f"{out_path.rstrip('/')}/{name}")
    cols = [c for c in df.columns if c != "month_date"]
    return df.select(F.col("month_date").cast("date").alias("month_date"), *cols)
