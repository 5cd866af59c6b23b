"""Batch job: compute reports from a stored base table and write each one.

    spark-submit --py-files tierscope.zip -m tierscope.jobs \\
        --table s3://bucket/customer_monthly_metrics --out s3://bucket/reports

(or ``python -m tierscope.jobs`` locally). The session comes from the
launcher; nothing is collected to the driver - every report is written by
the executors.
"""

from __future__ import annotations

import argparse

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tierscope.operators import cube, report, segments
from tierscope.plans import registry
from tierscope.sources import published
from tierscope.sources.base_table import load_base_table, read_base_table


# Reports that one cube of the table holds: a job that writes several reads the table once.
CUBE_REPORTS = {
    "m01_monthly_metrics": cube.monthly_metrics,
    "m02_arr_by_plan": cube.arr_by_plan,
    "m03_plan_distribution": cube.plan_distribution,
    "m07_revenue_by_geography": lambda c: cube.breakdown_latest(c, "country"),
    "m08_industry_breakdown": lambda c: cube.breakdown_latest(c, "industry"),
    "m10_latest_snapshot": cube.latest_snapshot,
    "m11_mau_metrics": cube.mau_metrics,
    "m12_inactive_rate_current": cube.inactive_rate_current,
    "m15_usage_trends_by_plan": cube.usage_trends_by_plan,
    "a01_kpi_growth": lambda c: report.kpi_growth(cube.latest_snapshot(c)),
    "a03_arr_moving_average": lambda c: report.moving_average(cube.monthly_metrics(c)),
    "a04_arr_pivot_by_plan": lambda c: report.pivot_by_plan(cube.arr_by_plan(c)),
    "a06_arr_stacked_by_plan": lambda c: report.stacked_by_plan(cube.arr_by_plan(c)),
    "a07_plan_mix_latest": lambda c: report.plan_mix_latest(cube.plan_distribution(c)),
    "a09_top_countries_bar": lambda c: report.top_by_value(cube.breakdown_latest(c, "country"), "country"),
    "a09_top_industries_bar": lambda c: report.top_by_value(cube.breakdown_latest(c, "industry"), "industry"),
    "a13_industry_table": lambda c: report.breakdown_table(cube.breakdown_latest(c, "industry"), "industry"),
    "a13_country_table": lambda c: report.breakdown_table(cube.breakdown_latest(c, "country"), "country"),
    "a20_mau_long": lambda c: report.mau_long(cube.mau_metrics(c)),
}


def publish_reports(base: DataFrame, root: str, names: list[str] | None = None, fmt: str = "parquet") -> str:
    """Write the reports as one version under ``root`` and switch readers to it when all
    of them are there (``published.current`` is the folder to read)."""
    return published.publish(base.sparkSession, root, lambda folder: write_reports(base, folder, names, fmt=fmt))


def write_reports(base: DataFrame, out_path: str, names: list[str] | None = None,
                  mode: str = "overwrite", fmt: str = "parquet") -> list[str]:
    """Write each named report (default: all registered) to ``out_path/<name>``."""
    names = names or list(registry.OPERATORS)
    unknown = [n for n in names if n not in registry.OPERATORS]
    if unknown:
        raise ValueError(f"unknown reports: {unknown}")
    of_cube = [n for n in names if n in CUBE_REPORTS]
    found = None
    if len(of_cube) > 1:  # one row per month and value
        found = cube.month_cube(base).persist(StorageLevel.MEMORY_AND_DISK)
    shared = [n for n in names if n in registry.REFERRAL_FRAMES]
    referrals = None
    if len(shared) > 1:   # M19 and the frames over it: computed once
        referrals = segments.potential_referrals(base).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name in names:
            if referrals is not None and name in shared:
                out = registry.REFERRAL_FRAMES[name](referrals)
            elif found is not None and name in of_cube:
                out = CUBE_REPORTS[name](found)
            else:
                out = registry.OPERATORS[name](base)
            out.write.mode(mode).format(fmt).save(f"{out_path.rstrip('/')}/{name}")
    finally:
        for kept in (referrals, found):
            if kept is not None:
                kept.unpersist()
    return names


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="tierscope.jobs", description=__doc__.splitlines()[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--table", help="stored base table (parquet, partitioned by month_date)")
    src.add_argument("--sf-dir", help="test-data folder to derive the base table from")
    ap.add_argument("--out", required=True, help="output folder, one sub-folder per report")
    ap.add_argument("--reports", default="", help="comma-separated names (default: all)")
    ap.add_argument("--format", default="parquet")
    ap.add_argument("--publish", action="store_true", help="write a version and switch readers to it at the end")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName("tierscope-reports").getOrCreate()
    base = read_base_table(spark, args.table) if args.table else load_base_table(spark, args.sf_dir)
    names = [n for n in args.reports.split(",") if n] or None
    if args.publish:
        print(publish_reports(base, args.out, names, fmt=args.format))
        return
    for name in write_reports(base, args.out, names, fmt=args.format):
        print(name)


if __name__ == "__main__":
    main()
