"""M06 from stored histograms equals M06 over the table; the sketch keeps its error."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import SF001, row
from test_micro_tables import MICRO
from test_state import root_dir, rows, table
from tierscope.operators import usage
from tierscope.plans import inspect
from tierscope.sources.base_table import load_base_table
from tierscope.state import usage_histograms as uh


def test_three_appends(spark):
    base = load_base_table(spark, SF001)
    root = root_dir("usage")
    for k in range(3):
        uh.append(spark, root, base.where(F.month("month_date") % 3 == k), f"part{k}")
    got = uh.usage_by_plan(spark, root)
    assert rows(got) == rows(usage.usage_by_plan(base))
    assert not [f for f in got.inputFiles() if "month_date=" in f]
    assert "partial_count" in inspect.physical_plan(uh.histograms_of(base))


@pytest.mark.parametrize("name", [n for n in ("null_id", "status_null", "dupes", "odd_plans") if n in MICRO])
def test_micro_tables_row_by_row(spark, name):
    root = root_dir("usage")
    for k in range(2):
        uh.append(spark, root, table(spark, MICRO[name][k::2]), f"part{k}")
    assert rows(uh.usage_by_plan(spark, root)) == rows(usage.usage_by_plan(table(spark, MICRO[name])))


def test_sketched_medians_keep_their_rank_error(spark):
    rnd = random.Random(1)
    values = [int(rnd.lognormvariate(5, 2)) for _ in range(6000)]
    base = table(spark, [row(i, f"2023-{1 + i % 6:02d}-28", plan="Top", e28=v, daily=v % 7) for i, v in enumerate(values)])
    root = root_dir("usage")
    for k in range(3):
        uh.append(spark, root, base.where(F.month("month_date") % 3 == k), f"part{k}")
    got = uh.usage_by_plan(spark, root, exact_median=False).first()
    ordered = sorted(values)
    lo, hi = ordered[int(0.48 * len(ordered))], ordered[int(0.52 * len(ordered))]
    assert lo <= got.median_events_28d <= hi
    assert uh.usage_by_plan(spark, root).first().median_events_28d == usage.usage_by_plan(base).first().median_events_28d
