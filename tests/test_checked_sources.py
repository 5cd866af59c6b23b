"""Corrections, checks while writing, quarantined text records, JDBC predicates."""

import datetime as dt
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001, row
from test_state import assert_reports, root_dir, rows, table
from tierscope.operators import quality
from tierscope.plans import inspect
from tierscope.plans.maintained import corrected
from tierscope.plans.registry import OPERATORS
from tierscope.sources import base_table, changes, checked, published
from tierscope.sources.base_table import load_base_table, write_base_table
from tierscope.state import customer_state as cs
from tierscope.streaming import refresh


def test_differences_are_of_multisets(spark):
    a = [row(1, "2023-01-31"), row(1, "2023-01-31"), row(2, "2023-01-31"), row(None, "2023-01-31", country=None, industry="x"),
         row(3, "2023-02-28"), row(5, "2023-02-28")]
    b = [row(1, "2023-01-31"), row(2, "2023-01-31", arr="1.00"), row(None, "2023-01-31", country="x", industry=None),
         row(4, "2023-02-28"), row(5, "2023-02-28")]
    got = {tuple(r) for r in changes.differences(table(spark, a), table(spark, b)).collect()}
    jan, feb = dt.date(2023, 1, 31), dt.date(2023, 2, 28)
    assert got == {(1, jan, "changed", 2, 1, 1, 0), (2, jan, "changed", 1, 1, 1, 1), (None, jan, "changed", 1, 1, 1, 1),
                   (3, feb, "deleted", 1, 0, 1, 0), (4, feb, "inserted", 0, 1, 0, 1)}
    assert changes.differences(table(spark, a), table(spark, a[::-1])).count() == 0
    plan = inspect.physical_plan(changes.differences(table(spark, a), table(spark, b)))
    assert "Join" not in plan and "partial_count" in plan


def test_refresh_after_corrections_equals_recomputation(spark):
    base = load_base_table(spark, SF001).where("month_date >= '1997-06-01'")
    new = corrected(base)
    old_path, new_path, reports, state = (root_dir(n) for n in ("old", "new", "reports", "state"))
    write_base_table(base, old_path)
    write_base_table(new, new_path)
    refresh.refresh_published(spark, old_path, reports, base.select("month_date").distinct())
    cs.update_state(spark, state, base, 4)
    found = refresh.refresh_corrected(spark, base, new, new_path, reports, state)
    assert {r.kind for r in found.select("kind").distinct().collect()} == {"changed", "deleted"}
    whole = base_table.read_base_table(spark, new_path)
    for name, op in refresh.MONTH_LOCAL_REPORTS.items():
        want = op(whole)
        assert rows(refresh.read_published(spark, reports, name).select(*want.columns)) == rows(want), name
    assert_reports(whole, cs.read_state(spark, state))


def test_counts_while_writing_equal_the_checks(spark):
    base = load_base_table(spark, SF001)
    root = root_dir("checked")
    m = checked.publish_base_table(base, root, checked.Rules(most_missing={"country": 0.9}))
    stored = checked.read_published_table(spark, root)
    profile = quality.profile(stored).first()
    assert (m["records"], m["first_month"], m["last_month"]) == (profile.records, profile.first_month, profile.last_month)
    for r in quality.completeness(stored).where("scope = 'all' OR plan IS NOT NULL").collect():
        tail = "" if r.scope == "all" else f"__{r.plan}"
        got = m[f"records{tail}"], m[f"{r.column_name}__null{tail}"], m[f"{r.column_name}__blank{tail}"]
        assert got == (r.rows, r.null_count, r.blank_count), r
    assert m["free_with_arr"] == base.where("plan = 'Free' AND annual_recurring_revenue > 0").count()
    with pytest.raises(checked.QualityBreach, match="country is missing"):
        checked.publish_base_table(base.withColumn("country", F.lit(None)), root, checked.Rules(most_missing={"country": 0.9}))
    with pytest.raises(checked.QualityBreach, match="fewer than"):
        checked.publish_base_table(base.where("false"), root)
    assert checked.read_published_table(spark, root).count() == base.count()
    assert len([n for n in os.listdir(f"{root}/_commits") if not n.startswith(".")]) == 1 and published.current(spark, root)


def test_counted_twice_is_counted_again(spark, monkeypatch):
    class Twice(checked.Observation):
        @property
        def get(self):
            return {k: v * 2 if isinstance(v, int) else v for k, v in super().get.items()}

    monkeypatch.setattr(checked, "Observation", Twice)
    m = checked.publish_base_table(table(spark, [row(1, "2023-01-31"), row(2, "2023-01-31", country="")]), root_dir("checked"))
    assert m["records"] == 2 and m["country__blank"] == 1


def lines_of(fmt, good):
    if fmt == "json":
        own = [json.dumps(dict(zip([f.name for f in base_table.BASE_SCHEMA.fields], map(str, r)))) for r in good]
        return own + ["{broken", '{"id": "x1", "month_date": "2023-01-31"}', '{"id": 9, "month_date": "2023-13-77"}', '{"month_date": "2023-01-31"}', '{"id": 4}']
    head = ",".join(f.name for f in base_table.BASE_SCHEMA.fields)
    n = len(base_table.BASE_SCHEMA.fields)
    own = [",".join("" if v is None else str(v) for v in r) for r in good]
    return [head, *own, "x1,2023-01-31" + "," * (n - 2), "9,2023-13-77" + "," * (n - 2), ",2023-01-31" + "," * (n - 2),
            "4" + "," * (n - 1), "5,2023-01-31,Top,maybe" + "," * (n - 4)]


@pytest.mark.parametrize("fmt", ["csv", "json"])
def test_bad_records_are_quarantined(spark, fmt):
    folder = root_dir("text")
    os.makedirs(folder)
    good = [(k, "2023-01-31", "Top", "true", "10.50", "3", "4", "NL", "IT", "2022-01-01", "2022-02-01") for k in range(3)]
    names = [f.name for f in base_table.BASE_SCHEMA.fields]
    order = dict(zip(["id", "month_date", "plan", "is_active", "annual_recurring_revenue", "events_daily", "events_28d", "country",
                      "industry", "account_created_date", "first_paid_date"], range(11)))
    good = [tuple(g[order[n]] for n in names) for g in good]
    if fmt == "json":  # numbers and truth values aren't texts
        text = lines_of(fmt, good)
        fix = lambda d: {k: (int(v) if k in ("id", "events_daily", "events_28d") else v == "true" if k == "is_active"
                             else float(v) if k == "annual_recurring_revenue" else v) for k, v in d.items()}
        text[:3] = [json.dumps(fix(json.loads(x))) for x in text[:3]]
    else:
        text = lines_of(fmt, good)
    with open(f"{folder}/part.{fmt}", "w") as f:
        f.write("\n".join(text) + "\n")
    ok, bad = checked.read_text(spark, folder, fmt)
    assert ok.schema.names == names and sorted(r.id for r in ok.collect()) == [0, 1, 2]
    assert ok.first().annual_recurring_revenue is not None and ok.first().is_active is True
    reasons = sorted(r.reason for r in bad.collect())
    assert len(reasons) == 5 and reasons.count("unreadable") == 3 and {"no id", "no month_date"} < set(reasons)
    assert OPERATORS["m02_arr_by_plan"](ok).count() == 1
    with pytest.raises(ValueError):
        checked.read_text(spark, folder, "parquet")


@pytest.mark.parametrize("months", [[], [(dt.date(2023, 1, 31), 5)], [(None, 3), (dt.date(2023, 3, 31), 900), (dt.date(2023, 1, 31), 250),
                                                                       (dt.date(2023, 2, 28), 10)]])
def test_month_predicates_are_disjoint_and_complete(months):
    clauses = base_table.month_predicates(months, rows_per_task=100)
    con = duckdb.connect()
    con.sql("""CREATE TABLE t AS SELECT id, month_date FROM (SELECT unnest([NULL, 0, 1, -1, 7, -8, 12345678901]) AS id),
               (SELECT unnest([NULL, DATE '2020-01-01', DATE '2023-01-31', DATE '2023-02-01', DATE '2023-02-28',
                               DATE '2023-03-31', DATE '2030-01-01']) AS month_date)""")
    hits = " + ".join(f"coalesce(({c})::INT, 0)" for c in clauses)
    assert con.sql(f"SELECT min({hits}), max({hits}), count(*) FROM t").fetchall() == [(1, 1, 49)]
    if len(months) > 2:
        assert len(clauses) == 3 + 1 + 9 + 1
