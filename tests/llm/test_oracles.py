"""Queries that SQL can express, against that SQL on whole tables."""

import pytest

from oracle_compare import compare, duck
from tierscope.llm import queries as q
from tierscope.llm.oracle import SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(SQL) - {"op1_benchmark_decontamination"}))
def test_query_equals_sql(spark, name):
    got = compare(q.queries()[name](spark, SF), duck(SF), SQL[name])
    assert got["ok"], got


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in q.queries()) == list(range(1, 14))
    assert set(SQL) <= set(q.queries())
