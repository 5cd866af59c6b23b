"""Customer state: equal to the reports over all history, from new rows only."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF001, row
from oracle_compare import rows_of
from test_micro_tables import MICRO as TABLES
from tierscope.operators import growth, quality, revenue
from tierscope.plans import inspect
from tierscope.sources import published
from tierscope.sources.base_table import load_base_table, read_base_table, write_base_table
from tierscope.sources.schema import BASE_SCHEMA
from tierscope.state import customer_state as cs


NULLABLE = T.StructType([T.StructField(f.name, f.dataType) for f in BASE_SCHEMA.fields])


def table(spark, rows):
    return spark.createDataFrame(rows, NULLABLE)


def root_dir(name="state"):
    return os.path.join(tempfile.mkdtemp(prefix="tierscope-state-"), name)


def rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def assert_reports(base, state):
    assert rows(cs.new_customers(state)) == rows(growth.new_customers(base))
    for free in (False, True):
        assert rows(cs.conversion_funnel(state, free)) == rows(growth.conversion_funnel(base, free))
    for options in ({}, {"nulls": "last", "plan_by": "rank"}):
        assert rows(cs.new_customers_of_note(base, state, **options)) == rows(revenue.new_customers_of_note(base, **options))
    assert rows(cs.stopped_customers(base, state)) == rows(quality.stopped_customers(base))


def appended(spark, base, root, orders, buckets=4):
    for k, months in enumerate(orders):
        state = cs.update_state(spark, root, base.where(F.col("month_date").isin(months)), buckets, label=f"b{k}")
    return state


def test_three_appends_out_of_order(spark):
    base = load_base_table(spark, SF001)
    months = sorted(r[0] for r in base.select("month_date").distinct().collect())
    third = len(months) // 3
    state = appended(spark, base, root_dir(), [months[2 * third:], months[:third], months[third:2 * third]])
    assert_reports(base, state)


@pytest.mark.parametrize("name", sorted(TABLES))
def test_micro_tables_row_by_row(spark, name):
    base = table(spark, TABLES[name])
    root = root_dir()
    half = len(TABLES[name]) // 2
    cs.update_state(spark, root, table(spark, TABLES[name][half:]), 2)
    assert_reports(base, cs.update_state(spark, root, table(spark, TABLES[name][:half]), 2))


def test_replayed_update_counts_once(spark):
    root, new = root_dir(), table(spark, [row(1, "2023-01-31"), row(None, "2023-01-31")])
    cs.update_state(spark, root, new, 2, label="batch-1")
    state = cs.update_state(spark, root, new, 2, label="batch-1")
    assert sorted((r.no_id, r.n_rows) for r in state.collect()) == [(False, 1), (True, 1)]


def test_corrections(spark):
    old = [row(1, "2022-12-31", arr=None), row(1, "2023-01-31"), row(2, "2023-01-31"), row(None, "2023-02-28")]
    fixed = [row(1, "2023-01-31"), row(None, "2023-03-31")]
    root = root_dir()
    cs.update_state(spark, root, table(spark, old), 2)
    ids = spark.createDataFrame([(1,), (2,), (None,)], "id bigint")
    base = table(spark, fixed)
    state = cs.replace_customers(spark, root, base, ids, 2)
    assert state.count() == 2
    assert_reports(base, state)


def test_state_is_read_where_it_lies(spark):
    """No exchange on the state's side, no file of history for M05, M09, M14."""
    base_path = root_dir("table")
    old = [row(i, f"2022-{m:02d}-28") for i in range(40) for m in range(1, 13)]
    new = [row(i, "2023-01-31") for i in range(20, 60)]
    write_base_table(table(spark, old + new), base_path)
    base = read_base_table(spark, base_path)
    root = root_dir()
    cs.update_state(spark, root, table(spark, old), 4)
    state = cs.read_state(spark, root)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        update = cs.merged(state, cs.state_of(table(spark, new)))
        plan = inspect.physical_plan(update)
        of_new = inspect.physical_plan(cs.state_of(table(spark, new)))
        assert "Bucketed: true" in plan and plan.count(") Exchange") // 2 <= of_new.count(") Exchange") // 2 + 1
        state = cs.update_state(spark, root, table(spark, new), 4)
        note = cs.new_customers_of_note(base, state)
        plan = inspect.physical_plan(note)
        assert "Bucketed: true" in plan
        # the base table is shuffled by customer, the state isn't
        assert sum("hashpartitioning(customer" in line for line in plan.splitlines()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for report in (cs.new_customers(state), cs.conversion_funnel(state)):
        assert not [f for f in report.inputFiles() if "month_date=" in f]
    filters = [f for f in inspect.partition_filters(note) if "month_date" in f]
    assert filters and all("ubquery" in f for f in filters)
    assert_reports(base, state)


def test_a_new_session_finds_the_buckets(spark):
    root = root_dir()
    cs.update_state(spark, root, table(spark, [row(1, "2023-01-31")]), 2)
    version = published.current(spark, root)
    spark.sql(f"DROP TABLE {cs._table(version + '/state-2')}")  # an external table: the files stay
    state = cs.read_state(spark, root)
    assert state.count() == 1 and "Bucketed: true" in inspect.physical_plan(state.groupBy(*cs.KEYS).count())


def test_publishing(spark):
    root = root_dir()
    write = lambda n: lambda path: spark.range(n).write.parquet(path)
    assert published.current(spark, root) is None
    first = published.publish(spark, root, write(1), "a")
    seen = spark.read.parquet(first)

    def dies(path):
        write(5)(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError, match="lost"):
        published.publish(spark, root, dies)
    assert published.current(spark, root) == first and spark.read.parquet(first).count() == 1
    assert len([n for n in os.listdir(root) if n.startswith("v")]) == 2
    second = published.publish(spark, root, write(2), "b")
    assert seen.count() == 1  # a reader that began with the first version goes on
    assert published.current(spark, root) == second and published.current_label(spark, root) == "b"
    for n in range(3, 7):
        published.publish(spark, root, write(n))
    assert len([n for n in os.listdir(root) if n.startswith("v")]) == published.KEEP + 1
    with pytest.raises(ValueError):
        published.publish(spark, root, write(1), "a/b")
