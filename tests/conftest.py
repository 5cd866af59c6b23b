import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tierscope.session import get_or_create_session  # noqa: E402
from tierscope.sources.schema import BASE_SCHEMA, COLUMNS  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_or_create_session(
        "local[4]", shuffle_partitions=2, app_name="tierscope-tests",
        extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="tierscope-test-ckpt-"),
               "spark.driver.memory": "4g"})
    yield s
    s.stop()


def D(s):
    return dt.date.fromisoformat(s)


def row(id, month, plan="Top", active=True, arr="1000.00", daily=1, e28=10, country=None,
        industry=None, created="2020-01-15", first_paid=None):
    return (id, D(month), plan, active, None if arr is None else Decimal(arr), daily, e28,
            country, industry, None if created is None else D(created),
            None if first_paid is None else D(first_paid))


def table(spark, rows):
    return spark.createDataFrame(rows, BASE_SCHEMA)


@pytest.fixture
def make_table(spark):
    return lambda rows: table(spark, rows)


__all__ = ["COLUMNS", "D", "row", "table", "SF001", "SF01"]
