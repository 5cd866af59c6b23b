"""The streaming refresh keeps the month-local reports equal to the batch
operators over the whole table, as months land in two separate drops."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF001
from oracle_compare import rows_of
from tierscope.sources.base_table import load_base_table, write_base_table
from tierscope.streaming import MONTH_LOCAL_REPORTS, read_report, start_refresh


def _rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def test_refresh_matches_batch_after_two_drops(spark):
    base = load_base_table(spark, SF001)
    cut = base.select(F.max("month_date")).first()[0].replace(day=1)  # last month in drop 2
    root = tempfile.mkdtemp(prefix="tierscope-stream-")
    src, out, ckpt = (os.path.join(root, d) for d in ("table", "reports", "ckpt"))

    write_base_table(base.filter(F.col("month_date") < cut), src, mode="append")
    q = start_refresh(spark, src, out, ckpt, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None

    write_base_table(base.filter(F.col("month_date") >= cut), src, mode="append")
    q = start_refresh(spark, src, out, ckpt, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None

    for name, op in MONTH_LOCAL_REPORTS.items():
        got = read_report(spark, out, name)
        want = op(base)
        assert _rows(got.select(*want.columns)) == _rows(want), name


def test_refresh_replayed_in_small_batches_is_idempotent(spark):
    """Replaying the whole table from a fresh checkpoint, a few files per
    micro-batch, over existing report output leaves exactly the batch results
    (each batch overwrites whole month partitions, never appends)."""
    base = load_base_table(spark, SF001)
    root = tempfile.mkdtemp(prefix="tierscope-stream-")
    src, out = os.path.join(root, "table"), os.path.join(root, "reports")
    write_base_table(base, src, mode="append")
    for attempt in ("ckpt-a", "ckpt-b"):          # second run replays everything again
        q = start_refresh(spark, src, out, os.path.join(root, attempt), available_now=True,
                          max_files_per_trigger=7)
        q.awaitTermination(600)
        assert q.exception() is None
        assert len(q.recentProgress) > 1            # several micro-batches ran
    for name, op in MONTH_LOCAL_REPORTS.items():
        want = op(base)
        assert _rows(read_report(spark, out, name).select(*want.columns)) == _rows(want), name


def test_month_that_loses_its_active_rows_is_cleared(spark):
    from conftest import row, table
    from tierscope.streaming import refresh_months
    root = tempfile.mkdtemp(prefix="tierscope-stream-")
    src, out = os.path.join(root, "table"), os.path.join(root, "reports")
    write_base_table(table(spark, [row(1, "2023-01-31"), row(1, "2023-02-28")]), src)
    months = spark.createDataFrame([("2023-01-31",), ("2023-02-28",)], "m string").select(
        F.col("m").cast("date").alias("month_date"))
    refresh_months(spark, src, out, months)
    assert read_report(spark, out, "arr_by_plan").count() == 2
    write_base_table(table(spark, [row(1, "2023-01-31"), row(1, "2023-02-28", active=False)]), src)
    refresh_months(spark, src, out, months.where("month_date = date'2023-02-28'"))
    base = spark.read.parquet(src)
    for name, op in MONTH_LOCAL_REPORTS.items():
        want = op(base)
        got = spark.read.schema(want.schema).parquet(f"{out}/{name}").select(*want.columns)
        assert _rows(got) == _rows(want), name


def test_untouched_months_are_not_read(spark):
    import datetime as dt

    from conftest import row, table
    from tierscope.plans import inspect
    from tierscope.streaming.refresh import touched_rows
    src = os.path.join(tempfile.mkdtemp(prefix="tierscope-stream-"), "table")
    write_base_table(table(spark, [row(1, "2023-01-31"), row(1, "2023-02-28")]), src)
    rows = touched_rows(spark, src, [dt.date(2023, 2, 28)])
    filters = inspect.partition_filters(rows)
    assert len(filters) == 1 and "2023-02-28" in filters[0] and "month_date" in filters[0]
    assert {f.rsplit("/", 2)[-2] for f in rows.select("month_date", "id").inputFiles()} >= {"month_date=2023-02-28"}
    assert rows.count() == 1 and touched_rows(spark, src, [None]).count() == 0
