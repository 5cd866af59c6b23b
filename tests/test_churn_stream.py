"""M04 by the stream equals M04 of the batch, late and repeated files included."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001, row
from test_micro_tables import MICRO
from test_state import assert_reports, root_dir, rows, table
from tierscope.operators import growth
from tierscope.sources.base_table import conform, load_base_table
from tierscope.sources.schema import BASE_SCHEMA
from tierscope.streaming import churn


@pytest.mark.parametrize("name", [n for n in ("null_id", "dupes", "null_month", "status_null", "gap") if n in MICRO])
def test_rows_in_any_order(spark, name):
    root = root_dir("churn")
    data = MICRO[name]
    for k, part in enumerate((data[1::2], data[::2], data[:1])):  # late rows, then a repeated one
        churn.apply_batch(spark, table(spark, part), k, root, buckets=2)
    assert rows(churn.read_churn(spark, root)) == rows(growth.churn_metrics(table(spark, data + data[:1])))


def test_replay_and_foreign_runs(spark):
    root = root_dir("churn")
    new = table(spark, [row(1, "2023-01-31"), row(1, "2023-02-28", active=False)])
    for _ in range(2):
        churn.apply_batch(spark, new, 0, root, "run", 2)
    assert rows(churn.read_churn(spark, root)) == rows(growth.churn_metrics(new))
    with pytest.raises(ValueError, match="another run"):
        churn.apply_batch(spark, new, 1, root, "other", 2)


def test_batch_that_dies_before_publishing_is_applied_once(spark, monkeypatch):
    root = root_dir("churn")
    a, b = table(spark, [row(1, "2023-01-31")]), table(spark, [row(1, "2023-02-28", active=False), row(1, "2022-12-31")])
    churn.apply_batch(spark, a, 0, root, "r", 2)
    with monkeypatch.context() as m:
        m.setattr(churn.cs, "_write", lambda *x: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            churn.apply_batch(spark, b, 1, root, "r", 2)
    assert churn.read_churn(spark, root).count() == 0
    churn.apply_batch(spark, b, 1, root, "r", 2)
    assert rows(churn.read_churn(spark, root)) == rows(growth.churn_metrics(a.unionByName(b)))


def test_history_is_not_opened_for_timely_rows(spark, monkeypatch):
    root = root_dir("churn")
    churn.apply_batch(spark, table(spark, [row(1, "2023-01-31")]), 0, root, "r", 2)
    opened = []
    real = churn._history
    monkeypatch.setattr(churn, "_history", lambda r: opened.append(r) or real(r))
    churn.apply_batch(spark, table(spark, [row(1, "2023-02-28", active=False), row(2, "2020-01-31")]), 1, root, "r", 2)
    assert len(opened) == 1  # to store the batch
    churn.apply_batch(spark, table(spark, [row(1, "2022-02-28")]), 2, root, "r", 2)
    assert len(opened) == 3


def test_stream_of_small_batches(spark):
    """Files of months in mixed order, three a batch, one of them twice; also the
    customer state that the stream keeps."""
    base = load_base_table(spark, SF001)
    months = sorted(r[0] for r in base.select("month_date").distinct().collect())
    src = root_dir("files")
    cuts = [months[:60], months[70:], months[60:70], months[:1]]
    for part in cuts:
        conform(base.where(F.col("month_date").isin(part))).coalesce(1).write.mode("append").parquet(src)
    root, ckpt = root_dir("churn"), root_dir("ckpt")
    q = churn.start_churn(spark, src, root, ckpt, available_now=True, max_files_per_trigger=1, buckets=2)
    q.awaitTermination(300)
    assert q.exception() is None and len([p for p in q.recentProgress if p.numInputRows]) >= 4
    whole = spark.read.schema(BASE_SCHEMA).parquet(src)
    assert whole.count() > base.count()
    assert rows(churn.read_churn(spark, root)) == rows(growth.churn_metrics(whole))
    assert_reports(whole, churn.read_customers(spark, root))
    assert os.path.isdir(f"{root}_batches")
