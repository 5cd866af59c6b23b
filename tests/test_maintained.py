"""Queries from kept state against the SQL of the whole history; publishing of reports."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001, row
from oracle_compare import compare, duck
from test_state import root_dir, rows, table
from tierscope import jobs
from tierscope.plans import maintained, registry
from tierscope.sources import published
from tierscope.sources.base_table import load_base_table, write_base_table
from tierscope.streaming import refresh


def test_queries_match_oracle(spark):
    con, sql = duck(SF001), maintained.oracle_sql()
    assert set(sql) == set(maintained.queries())
    bad = {n: r for n, q in maintained.queries().items() if not (r := compare(q(spark, SF001), con, sql[n]))["ok"]}
    assert not bad, bad


def test_published_reports_are_whole(spark, monkeypatch):
    base = load_base_table(spark, SF001)
    root = root_dir("reports")
    names = ["m01_monthly_metrics", "m02_arr_by_plan", "a04_arr_pivot_by_plan", "a13_country_table", "a01_kpi_growth",
             "a20_mau_long", "m05_new_customers"]
    first = jobs.publish_reports(base, root, names)
    for n in names:
        assert rows(spark.read.parquet(f"{first}/{n}")) == rows(registry.OPERATORS[n](base)), n
    monkeypatch.setitem(registry.OPERATORS, "m05_new_customers", lambda df: df.select(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        jobs.publish_reports(base, root, names)
    assert published.current(spark, root) == first


def test_cube_reports_read_the_table_once(spark, monkeypatch):
    base = load_base_table(spark, SF001)
    calls = []
    real = jobs.cube.month_cube
    monkeypatch.setattr(jobs.cube, "month_cube", lambda df: calls.append(1) or real(df))
    for n in jobs.CUBE_REPORTS:
        monkeypatch.setitem(registry.OPERATORS, n, lambda df: pytest.fail("reads the table again"))
    out = root_dir("out")
    assert jobs.write_reports(base, out, ["m03_plan_distribution", "m12_inactive_rate_current", "m08_industry_breakdown"])
    assert calls == [1] and len(os.listdir(out)) == 3


def test_published_refresh(spark):
    root, src = root_dir("published"), root_dir("table")
    months = lambda *m: spark.createDataFrame([(x,) for x in m], "m string").select(
        F.col("m").cast("date").alias("month_date"))
    write_base_table(table(spark, [row(1, "2023-01-31", country="NL"), row(1, "2023-02-28"), row(2, "2023-02-28", plan="Low")]), src)
    refresh.refresh_published(spark, src, root, months("2023-01-31", "2023-02-28"))
    old = refresh.read_published(spark, root, "arr_by_plan")
    assert old.count() == 3
    write_base_table(table(spark, [row(1, "2023-01-31", country="NL"), row(1, "2023-02-28", active=False),
                                   (3, None, *row(3, "2023-01-31")[2:])]), src)
    version = refresh.refresh_published(spark, src, root, months("2023-02-28", None))
    assert old.count() == 3  # the version that a reader has begun with
    base = spark.read.schema(table(spark, []).schema).parquet(src)
    theirs = dict(refresh.MONTH_LOCAL_REPORTS) | {
        "revenue_by_geography": registry.OPERATORS["m07_revenue_by_geography"],
        "latest_snapshot": registry.OPERATORS["m10_latest_snapshot"]}
    for name, op in theirs.items():
        want = op(base)
        assert rows(refresh.read_published(spark, root, name).select(*want.columns)) == rows(want), name
    assert refresh.refresh_published(spark, src, root, months().where("false")) == version


def test_stream_publishes(spark):
    base = load_base_table(spark, SF001)
    src, root, ckpt = root_dir("table"), root_dir("published"), root_dir("ckpt")
    write_base_table(base.where("month_date >= '1998-01-01'"), src, mode="append")
    q = refresh.start_refresh(spark, src, root, ckpt, available_now=True, publish=True)
    q.awaitTermination(300)
    assert q.exception() is None
    whole = spark.read.schema(base.schema).parquet(src)
    for name, op in refresh.MONTH_LOCAL_REPORTS.items():
        want = op(whole)
        assert rows(refresh.read_published(spark, root, name).select(*want.columns)) == rows(want), name
