"""Hand-made micro tables (FIXTURES.md section 5): the edge cases the
generated data does not cover. Each is checked twice: against values worked
out by hand for the point under test, and - for every registered operator -
against the DuckDB oracle statement run on the same micro table."""

import os
import tempfile

import duckdb
import pytest

from conftest import D, row
from oracle_compare import rows_of
from tierscope.operators import growth, quality, report, revenue, segments, usage
from tierscope.plans import oracle, registry

M_END = ["2023-01-31", "2023-02-28", "2023-03-31", "2023-04-30", "2023-05-31", "2023-06-30",
         "2023-07-31", "2023-08-31"]


def _micro_tables():
    t = {}
    t["empty"] = []
    t["one_month"] = [row(i, "2023-01-31", arr=a) for i, a in ((1, "10.00"), (2, None),
                                                               (3, "5.50"))]
    t["null_order"] = [
        row(1, "2023-02-28", arr=None, country="A", industry="X", created="2023-02-01"),
        row(2, "2023-02-28", arr="5.00", country="B", industry="Y", created="2023-02-01"),
        row(3, "2023-02-28", arr="7.00", country="C", industry="", created="2023-02-01"),
        row(4, "2023-01-31", arr="9.00", country="C", created="2023-01-01"),
        row(4, "2023-02-28", arr="9.00", country="C", created="2023-01-01"),
        row(5, "2023-02-28", plan=None, arr="3.00", country="D", created="2023-02-01"),
    ]
    t["status_null"] = [row(1, m, active=a) for m, a in
                        (("2023-01-31", True), ("2023-02-28", None), ("2023-03-31", False))]
    t["gap"] = [row(1, m, active=a) for m, a in
                (("2023-01-31", True), ("2023-02-28", True), ("2023-04-30", False))]
    t["month_end"] = [row(1, m, plan=p, e28=500, created="2023-01-31") for m, p in
                      (("2023-02-28", "Free"), ("2023-03-30", "Low"), ("2023-03-31", "Top"))] + \
        [row(2, "2023-01-31", plan="Free", e28=300, created="2023-03-15"),
         row(2, "2023-02-28", plan="Top", e28=300, created="2023-03-15")]
    plans = {1: ["Trial", "Top"], 2: ["Top", "Low"], 3: ["Free", "Trial"], 4: ["Low", "Middle"]}
    t["plans"] = [row(i, M_END[k], plan=p, e28=200, created="2023-01-01")
                  for i, ps in plans.items() for k, p in enumerate(ps)]
    t["thresholds"] = (
        [row(1, m, plan="Free", e28=500) for m in M_END[2:]]
        + [row(2, m, plan="Trial", e28=e) for m, e in zip(M_END[3:], (500, 501, 500, 500, 502))]
        + [row(3, M_END[-1], arr="1000.00", e28=5), row(4, M_END[-1], arr="1000.01", e28=100),
           row(5, M_END[-1], arr="1000.01", e28=99)]
        + [row(6, m, plan=p, e28=e, created="2023-01-01")
           for m, p, e in zip(M_END[:5], ("Free", "Low", "Low", "Low", "Low"),
                              (100, 100, 100, 101, 101))]
        + [row(7, m, plan=p, e28=e, created="2023-01-01")
           for m, p, e in zip(M_END[:2], ("Free", "Low"), (100, 101))])
    t["ties"] = [row(i, "2023-01-31", arr="100.00", e28=50,
                     created=None if i == 3 else "2020-01-15") for i in range(1, 14)]
    t["rounding"] = [row(i, "2023-01-31", plan="Low", arr=a, e28=e, daily=d)
                     for i, (a, e, d) in enumerate((("0.01", 1, 1), ("0.02", 2, 2),
                                                    ("0.02", 0, 3), ("0.00", 0, 4)), start=1)]
    t["dupes"] = [row(1, "2023-01-31", active=True), row(1, "2023-01-31", active=False),
                  row(1, "2023-02-28", active=True), row(1, "2023-02-28", active=None),
                  row(1, "2023-03-31", active=False), row(2, "2023-02-28", active=True),
                  row(2, "2023-03-31", active=False), row(2, "2023-03-31", active=False)]
    t["first_seen"] = [row(1, "2023-01-31", created="2023-01-10", first_paid=None),
                       row(1, "2023-02-28", created="2023-01-10", first_paid="2023-02-28"),
                       row(2, "2023-02-28", created="2023-02-03", first_paid="2023-02-28")]
    # plan names outside the five tiers: MAX(plan) by text must still see them
    t["odd_plans"] = [row(1, M_END[k], plan=p, e28=300, created="2023-01-01")
                      for k, p in enumerate(("Free", "Zeta", "Top"))] + \
        [row(2, M_END[k], plan=p, e28=300, created="2023-01-01")
         for k, p in enumerate(("Low", "Enterprise", "Middle", ""))]
    # NULL months (the schema says NOT NULL; nothing enforces it): PostgreSQL
    # sorts them last ascending and first descending
    def no_month(r):
        return (r[0], None) + r[2:]
    t["null_month"] = [
        row(1, "2023-01-31", active=True), row(1, "2023-02-28", active=False),
        no_month(row(1, "2023-01-31", active=True)), row(2, "2023-02-28", e28=700, plan="Free"),
        row(2, "2023-03-31", active=False, plan="Trial", e28=650),
        no_month(row(3, "2023-01-31", plan="Low")), row(3, "2023-03-31", plan="Free", e28=600),
        row(4, "2023-03-31", arr="50.00", created="2023-03-02")]
    # NULL ids (also unenforced): COUNT(DISTINCT id) skips them, GROUP BY keeps
    # them as one group, joins never match them, ascending order puts them last
    def no_id(r):
        return (None,) + r[1:]
    t["null_id"] = [
        no_id(row(1, "2023-02-28", arr="500.00", e28=50, plan="Free")),
        no_id(row(1, "2023-01-31", arr="300.00", active=False)),
        no_id(row(1, "2023-01-31", arr="300.00", e28=0)),
        row(1, "2023-02-28", arr="500.00", e28=50, plan="Free"),
        row(2, "2023-02-28", arr="400.00", e28=700, plan="Trial"),
        row(2, "2023-01-31", arr="400.00", plan="Low"),
        row(3, "2023-01-31", active=False)]
    return t


NULLABLE = {"null_month", "null_id"}


MICRO = _micro_tables()
REPORT_TABLES = {"empty", "one_month", "null_order", "plans", "rounding", "null_month",
                 "null_id"}


@pytest.fixture(scope="module")
def micro(spark):
    """name -> (Spark DataFrame, DuckDB connection with the table as ``cmm``)."""
    out = {}
    root = tempfile.mkdtemp(prefix="tierscope-micro-")
    from conftest import table
    from pyspark.sql import types as T
    from tierscope.sources.schema import BASE_SCHEMA
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in BASE_SCHEMA.fields])
    for name, rows in MICRO.items():
        df = spark.createDataFrame(rows, nullable) if name in NULLABLE else table(spark, rows)
        path = os.path.join(root, name)
        df.coalesce(1).write.parquet(path)
        con = duckdb.connect()
        con.sql(f"CREATE VIEW cmm AS SELECT * FROM read_parquet('{path}/*.parquet')")
        out[name] = (spark.read.parquet(path), con)
    return out


def _oracle_rows(con, body):
    body = body.strip()
    sql = ("WITH " + body[1:].lstrip()) if body.startswith(",") else body
    rel = con.sql(sql)
    return rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("table_name", sorted(MICRO))
def test_every_operator_matches_oracle_on_micro_table(micro, table_name):
    df, con = micro[table_name]
    bad = []
    for name, op in registry.OPERATORS.items():
        # report frames are compositions of the metric operators: cross-check
        # them on the tables that exercise their own edge cases only
        if name.startswith("a") and table_name not in REPORT_TABLES:
            continue
        out = op(df)
        got = rows_of(out.columns, [tuple(r) for r in out.collect()])
        want = _oracle_rows(con, oracle.B[name])
        if got != want:
            bad.append((name, got, want))
    assert not bad, bad[:2]


def test_empty_table(micro):
    df, _ = micro["empty"]
    snap = revenue.latest_snapshot(df).collect()
    assert [tuple(r) for r in snap] == [(0, None, 0, None)]
    assert revenue.monthly_metrics(df).count() == 0
    assert [tuple(r) for r in growth.conversion_funnel(df).collect()] == [(0, 0, None, None)]
    assert [tuple(r) for r in report.kpi_growth(revenue.latest_snapshot(df)).collect()] == \
        [(0, None, 0, None, 0.0, 0.0, 0.0)]


def test_one_month(micro):
    df, _ = micro["one_month"]
    assert [tuple(r) for r in revenue.latest_snapshot(df).collect()] == [(3, 15.5, 0, None)]
    assert growth.churn_metrics(df).count() == 0
    k = report.kpi_growth(revenue.latest_snapshot(df)).first()
    assert (k.customer_growth_pct, k.arr_growth_pct) == (0.0, 0.0)


def test_null_ordering(micro):
    df, _ = micro["null_order"]
    geo = [(r.country, r.total_arr) for r in revenue.revenue_by_geography(df).collect()]
    assert geo == [("A", None), ("C", 16.0), ("B", 5.0), ("D", 3.0)]  # S1: NULL first
    assert [r.industry for r in revenue.industry_breakdown(df).collect()] == ["X", "Y"]
    top = [r.customer_id for r in revenue.top_customers(df).collect()]
    assert top == [4, 3, 2, 5]                                  # ARR > 0 drops NULL ARR
    new = [r.customer_id for r in revenue.new_customers_of_note(df).collect()]
    assert new[0] == 1                                           # K6: NULL sum first
    assert [r.plan for r in revenue.arr_by_plan(df).collect()][-1] is None  # S2: NULL plan last


def test_status_null_three_valued(micro):
    df, _ = micro["status_null"]
    assert [tuple(r) for r in growth.churn_metrics(df).collect()] == [(D("2023-02-28"), 1, 0, 0.0)]


def test_gap_uses_previous_row(micro):
    df, _ = micro["gap"]
    churn = [tuple(r) for r in growth.churn_metrics(df).collect()]
    assert churn[-1] == (D("2023-04-30"), 1, 1, 100.0)            # K1: April vs February
    gaps = [tuple(r) for r in quality.month_gaps(df).collect()]
    assert gaps == [(1, D("2023-04-30"), D("2023-02-28"), 1)]


def test_month_end_ages(micro):
    df, _ = micro["month_end"]
    refs = {r.customer_id: r for r in segments.potential_referrals(df).collect()}
    # created Jan 31: Feb 28 -> 0 months, Mar 30 -> 1, Mar 31 -> 2; all within 6
    assert refs[1].months_observed == 3 and refs[1].upgrade_type == "Free/Trial → Paid"
    assert refs[2].months_observed == 2                          # K10: negative ages count


def test_plan_changes(micro):
    df, _ = micro["plans"]
    refs = {r.customer_id: (r.starting_plan_name, r.ending_plan_name, r.upgrade_type)
            for r in segments.potential_referrals(df).collect()}
    assert refs[1] == ("Trial", "Trial", "Free/Trial → Paid")   # K7: MAX by text
    assert refs[2] == (None, "Top", "Paid Tier Upgrade")         # K8: downgrade qualifies
    assert 3 not in refs                                         # Free -> Trial dropped
    assert refs[4] == (None, "Middle", "Paid Tier Upgrade")      # K9: NULL start name


def test_thresholds_are_strict(micro):
    df, _ = micro["thresholds"]
    opp = {r.customer_id: r.avg_events_28d for r in segments.high_opportunity_clients(df).collect()}
    assert opp == {2: 501.0}                                     # avg 500 dropped, 500.4 kept
    risk = [r.customer_id for r in usage.at_risk_accounts(df).collect()]
    assert risk == [5]                                           # ARR 1000 and events 100 out
    refs = {r.customer_id: r.avg_events for r in segments.potential_referrals(df).collect()}
    assert refs == {7: 101.0}                                    # K13: 100.4 -> 100 dropped


def test_top_k_ties_break_by_id(micro):
    df, _ = micro["ties"]
    top = revenue.top_customers(df).collect()
    assert [r.customer_id for r in top] == list(range(1, 11))
    assert top[2].years_as_client is None and top[0].years_as_client == 3.0  # AGE(x, NULL)
    assert [r.customer_id for r in usage.power_users(df).collect()] == list(range(1, 11))


def test_rounding_half_up(micro):
    df, _ = micro["rounding"]
    r = usage.usage_by_plan(df).first()
    assert (r.avg_events_daily, r.median_events_daily) == (3.0, 3.0)    # 2.5 -> 3, median 2.5 -> 3
    assert (r.avg_events_28d, r.median_events_28d) == (1.0, 1.0)        # 0.75 -> 1, 0.5 -> 1
    assert r.pct_inactive == 50.0
    m = revenue.arr_by_plan(df).first()
    assert m.avg_arr == 0.01                                            # 0.0125 -> 0.01


def test_duplicate_keys(micro):
    df, _ = micro["dupes"]
    m01 = {r.month_date: (r.active_customers, r.total_customers)
           for r in revenue.monthly_metrics(df).collect()}
    assert m01[D("2023-01-31")] == (1, 1)
    assert usage.usage_by_plan(df).first().customer_months == 3   # count(*), active rows
    assert [(r.id, r.copies) for r in quality.duplicate_keys(df).collect()] == [(1, 2), (1, 2),
                                                                                (2, 2)]


def test_unknown_plan_names_in_text_max(micro):
    df, _ = micro["odd_plans"]
    refs = {r.customer_id: r.ending_plan_name for r in segments.potential_referrals(df).collect()}
    assert refs == {1: "Zeta", 2: "Middle"}


def test_null_id_sorts_last_and_is_not_counted(micro):
    df, _ = micro["null_id"]
    assert [r.customer_id for r in revenue.top_customers(df).collect()] == [1, None, 2]  # tie at 500
    feb = [r for r in revenue.monthly_metrics(df).collect() if r.month_date == D("2023-02-28")][0]
    assert (feb.active_customers, feb.total_customers) == (2, 2)


def test_distinct_on_takes_earliest_row(micro):
    df, _ = micro["first_seen"]
    out = [tuple(r) for r in growth.new_customers(df).collect()]
    assert out == [(D("2023-01-01"), 1, 0), (D("2023-02-01"), 1, 1)]


# ---- opt-in corrections of the reference's quirks (defaults stay exact) ----

def test_option_calendar_strict_churn(micro):
    df, _ = micro["gap"]
    out = [tuple(r) for r in growth.churn_metrics(df, calendar_strict=True).collect()]
    assert out == [(D("2023-02-28"), 1, 0, 0.0)]             # April has no March predecessor


def test_option_new_customers_nulls_last(micro):
    df, _ = micro["null_order"]
    ids = [r.customer_id for r in revenue.new_customers_of_note(df, nulls="last").collect()]
    assert ids[0] == 4 and ids[-1] == 1


def test_option_rank_max_plan(micro):
    df, _ = micro["plans"]
    refs = {r.customer_id: r.ending_plan_name
            for r in segments.potential_referrals(df, plan_by="rank").collect()}
    assert refs[1] == "Top"


def test_option_ordered_upgrades(micro):
    df, _ = micro["plans"]
    refs = {r.customer_id: (r.starting_plan_name, r.ending_plan_name, r.upgrade_type)
            for r in segments.potential_referrals(df, ordered=True).collect()}
    assert refs == {1: ("Trial", "Top", "Free/Trial → Paid"),
                    4: ("Low", "Middle", "Paid Tier Upgrade")}  # Top -> Low no longer counts


def test_option_conversion_requires_free_start(micro):
    df, _ = micro["first_seen"]   # every row pays from the first month (ARR 1000)
    r = growth.conversion_funnel(df, require_free_start=True).first()
    assert (r.total_users, r.converted_users) == (2, 0)
    assert growth.conversion_funnel(df).first().converted_users == 2


@pytest.mark.parametrize("table_name", ["rounding", "dupes", "null_order"])
def test_sums_exact_with_ansi_off(spark, micro, table_name):
    """With ANSI off, integer sums fall back to DECIMAL(38,0); results must not change."""
    df, con = micro[table_name]
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        bad = []
        for name in ("m01_monthly_metrics", "m02_arr_by_plan", "m06_usage_by_plan",
                     "m10_latest_snapshot", "m14_new_customers_of_note", "m19_potential_referrals"):
            out = registry.OPERATORS[name](df)
            got = rows_of(out.columns, [tuple(r) for r in out.collect()])
            if got != _oracle_rows(con, oracle.B[name]):
                bad.append(name)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert not bad, bad
