"""Tasks that don't grow with the table: shuffles by its size, no sorts for aggregates."""

import re

import pytest
from pyspark.sql import functions as F

from conftest import SF001, row
from test_micro_tables import MICRO
from test_scans import table_scans
from test_state import root_dir, rows, table
from tierscope.functions.expr import sign_up_code, sign_up_of
from tierscope.operators import cube, growth
from tierscope.plans import inspect, maintained
from tierscope.sources import fixture
from tierscope.sources.base_table import load_base_table
from tierscope.state import customer_state as cs
from tierscope.streaming import churn


def test_base_table_is_dealt_by_its_rows(spark, monkeypatch):
    want = sorted(load_base_table(spark, SF001).collect(), key=str)
    monkeypatch.setattr(fixture, "CUSTOMERS_PER_TASK", 10)
    monkeypatch.setattr(fixture, "LINES_PER_TASK", 500)
    base = fixture.derive_base_table(spark, SF001)
    n_customers = -(-spark.read.parquet(f"{SF001}/customer.parquet").count() // 10)
    n_lines = -(-spark.read.parquet(f"{SF001}/lineitem.parquet").count() // 500)
    plan = inspect.physical_plan(base)
    assert re.search(rf"hashpartitioning\(id#\d+L?, {n_customers}\)", plan)
    assert len(re.findall(rf"hashpartitioning\([lo]_orderkey#\d+L?, {n_lines}\)", plan)) >= 2
    assert sorted(base.collect(), key=str) == want


def test_state_is_made_without_sorting_rows(spark):
    base = table(spark, [row(1, "2023-01-31"), row(None, "2023-01-31")])
    for df in (cs.per_month(base), cs.state_of(base)):
        plan = inspect.physical_plan(df)
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_sign_up_code_keeps_the_order(spark):
    days = "array(null, date'0001-01-01', date'1969-12-31', date'1970-01-01', date'2023-05-31', date'9999-12-31')"
    cases = spark.sql(f"SELECT explode({days}) AS month_date").crossJoin(
        spark.sql(f"SELECT explode({days}) AS account_created_date")).crossJoin(
        spark.sql(f"SELECT explode({days}) AS first_paid_date"))
    order = F.struct(F.col("month_date").isNull().alias("no_month"), "month_date", "account_created_date", "first_paid_date")
    out = cases.select(F.when(F.col("account_created_date").isNotNull(), order).alias("s"), sign_up_code().alias("c"))
    assert out.withColumn("back", sign_up_of("c")).where("NOT (s <=> back)").count() == 0
    known = out.where("c IS NOT NULL")
    by_struct = [r.c for r in known.orderBy("s").collect()]
    assert len(by_struct) == 180 and by_struct == sorted(by_struct) and len(set(by_struct)) == 180


@pytest.mark.parametrize("name", [n for n in ("null_id", "dupes", "null_month", "status_null", "gap") if n in MICRO])
def test_late_rows_between_and_beside_known_ones(spark, name):
    root, data = root_dir("churn"), MICRO[name] + [row(90, "2023-01-31"), row(90, "2023-04-30", active=False)]
    late = [row(90, "2023-02-28", active=None), row(90, "2023-04-30"), row(91, "2023-02-28"), (90, None, *row(90, "2023-01-31")[2:])]
    for k, part in enumerate((data, late, late[:2])):
        churn.apply_batch(spark, table(spark, part), k, root, buckets=2)
    whole = data + late + late[:2]
    assert rows(churn.read_churn(spark, root)) == rows(growth.churn_metrics(table(spark, whole)))


def test_corrections_read_history_once(spark):
    root = root_dir("churn")
    churn.apply_batch(spark, table(spark, [row(1, "2023-02-28")]), 0, root, buckets=2)
    months = cs.per_month(table(spark, [row(1, "2023-01-31")]))
    earlier = spark.read.parquet(churn._history(root))
    plan = inspect.physical_plan(churn._difference(earlier, months, months.select(*cs.KEYS)))
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 1


def test_feed_deals_the_state_by_the_rows(spark, monkeypatch):
    base, seen = load_base_table(spark, SF001), []
    monkeypatch.setattr(maintained, "_FED", {})
    monkeypatch.setattr(maintained, "ROWS_PER_BUCKET", 500)
    monkeypatch.setattr(maintained.usage_histograms, "append", lambda *a: None)
    monkeypatch.setattr(maintained.churn, "apply_batch", lambda s, part, k, root, run, buckets: seen.append(buckets))
    maintained.feed(spark, SF001)
    assert set(seen) == {-(-base.count() // 500)}


def test_bucket_has_one_file(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        root = root_dir()
        cs.update_state(spark, root, table(spark, [row(i, "2023-01-31") for i in range(50)]), 3)
        assert len(cs.read_state(spark, root).inputFiles()) == 3
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("report", [cube.latest_snapshot, cube.inactive_rate_current,
                                    lambda c: cube.breakdown_latest(c, "country")])
def test_latest_month_comes_from_one_cube(spark, report):
    base = load_base_table(spark, SF001)
    assert len(table_scans(inspect.executed_plan(report(cube.month_cube(base))))) == 2  # initial and final plan
