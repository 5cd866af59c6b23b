"""Sources and sinks: formats round-trip through the base schema, the writer
lays the table out by month, and the loader stores under the session's
checkpoint folder."""

import os
import tempfile

import pytest

from conftest import SF001, row, table
from oracle_compare import rows_of
from tierscope.session import scratch_dir
from tierscope.sources import (BASE_SCHEMA, load_base_table, read_base_table,
                               write_base_table)

ROWS = [row(1, "2023-01-31", country="NL", industry=""),
        row(2, "2023-02-28", plan=None, active=None, arr=None, created=None),
        row(3, "2023-02-28", first_paid="2023-02-28")]


def _rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_formats_round_trip(spark, fmt):
    df = table(spark, ROWS)
    path = os.path.join(tempfile.mkdtemp(prefix="tierscope-src-"), fmt)
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)
    back = read_base_table(spark, path, fmt)
    assert back.schema == BASE_SCHEMA or [f.dataType for f in back.schema.fields] == \
        [f.dataType for f in BASE_SCHEMA.fields]
    got, want = _rows(back), _rows(df)
    if fmt == "csv":   # CSV cannot tell an empty string from NULL
        want = (sorted([tuple(None if v == "" else v for v in r) for r in want[0]],
                       key=lambda t: tuple((v is None, v or "") for v in t)), want[1])
    assert got == want


def test_writer_partitions_by_month(spark):
    df = table(spark, ROWS)
    path = os.path.join(tempfile.mkdtemp(prefix="tierscope-src-"), "t")
    write_base_table(df, path)
    dirs = sorted(d for d in os.listdir(path) if d.startswith("month_date="))
    assert dirs == ["month_date=2023-01-31", "month_date=2023-02-28"]
    back = read_base_table(spark, path)
    assert [f.name for f in back.schema.fields] == [f.name for f in BASE_SCHEMA.fields]
    assert _rows(back) == _rows(df)


def test_loader_writes_under_session_checkpoint_dir(spark):
    root = scratch_dir(spark)
    assert root and root == spark.sparkContext.getCheckpointDir()
    df = load_base_table(spark, SF001)
    files = df.inputFiles()
    assert files and all(root.replace("file:", "") in f.replace("file:", "") for f in files)


def test_report_job_writes_each_report(spark):
    from tierscope.jobs import write_reports
    from tierscope.plans import registry
    base = load_base_table(spark, SF001)
    out = os.path.join(tempfile.mkdtemp(prefix="tierscope-job-"), "reports")
    names = ["m02_arr_by_plan", "m10_latest_snapshot", "r02_completeness"]
    assert write_reports(base, out, names) == names
    for n in names:
        assert _rows(spark.read.parquet(os.path.join(out, n))) == \
            _rows(registry.OPERATORS[n](base))
    with pytest.raises(ValueError):
        write_reports(base, out, ["no_such_report"])


def test_report_job_command_line(spark, capsys):
    from tierscope.jobs import main
    out = os.path.join(tempfile.mkdtemp(prefix="tierscope-cli-"), "reports")
    main(["--sf-dir", SF001, "--out", out, "--reports", "m19_potential_referrals"])
    assert capsys.readouterr().out.split() == ["m19_potential_referrals"]
    assert spark.read.parquet(os.path.join(out, "m19_potential_referrals")).count() == 18


def test_jdbc_options_split_and_fetch():
    from tierscope.sources.base_table import jdbc_options
    o = jdbc_options("jdbc:postgresql://h/db", properties={"user": "u"}, num_partitions=24,
                     lower="2021-09-30", upper="2023-09-30")
    assert o == {"user": "u", "url": "jdbc:postgresql://h/db", "dbtable": "customer_monthly_metrics",
                 "fetchsize": "10000", "partitionColumn": "month_date", "lowerBound": "2021-09-30",
                 "upperBound": "2023-09-30", "numPartitions": "24"}
    with pytest.raises(ValueError, match="bounds"):
        jdbc_options("jdbc:x")
    with pytest.raises(ValueError, match="positive"):
        jdbc_options("jdbc:x", lower=1, upper=2, num_partitions=0)


def test_month_list_is_dropped_when_another_writer_adds_a_month(spark):
    from tierscope.operators import latest
    path = os.path.join(tempfile.mkdtemp(prefix="tierscope-src-"), "t")
    write_base_table(table(spark, ROWS), path)
    assert latest._MONTHS.get(read_base_table(spark, path)) is not None
    table(spark, [row(9, "2023-03-31")]).write.mode("append").partitionBy("month_date").parquet(path)
    df = read_base_table(spark, path)
    assert latest._MONTHS.get(df) is None
    assert latest.latest_rows(df).count() == 1


def test_changed_input_is_derived_again(spark):
    import shutil
    root = tempfile.mkdtemp(prefix="tierscope-src-")
    for n in ("customer", "nation", "orders", "lineitem"):
        shutil.copy(f"{SF001}/{n}.parquet", f"{root}/{n}.parquet")
    first = load_base_table(spark, root)
    assert load_base_table(spark, root) is first
    os.utime(f"{root}/orders.parquet", (1, 1))
    assert load_base_table(spark, root) is not first
