"""Exact distinct counts that add up: bitmaps of customers per month and plan.

Each append is reduced to sums per (month, plan) and to bitmaps of 32,768 customer
ids per (month, plan, block of ids): all customers, active ones, and ones with
events. Bitmaps of several appends are united, so a late file adds to its month
without a look at the month's other files, and a customer in two files counts once.
The result has the columns of ``operators.cube``, so M01, M02, M03, M11 and M15 come
from it by the same functions.

A bitmap has 4 KB whatever it holds: dense ids cost about one bit each, ids that are
scattered widely up to 4 KB each; give such customers running numbers first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierscope.operators import cube
from tierscope.sources import published

BITMAPS = ["everyone", "active", "used"]


def sums_of(rows: DataFrame) -> DataFrame:
    """Additive measures per (month, plan)."""
    return rows.groupBy("month_date", "plan").agg(*cube.measures())


def bitmaps_of(rows: DataFrame) -> DataFrame:
    """Bitmaps per (month, plan, block of ids), built map-side; a NULL id is in none."""
    bit = F.bitmap_bit_position("id")
    return rows.where("id IS NOT NULL").groupBy(
        "month_date", "plan", F.bitmap_bucket_number("id").alias("block")).agg(
        F.bitmap_construct_agg(bit).alias("everyone"),
        F.bitmap_construct_agg(F.when(F.col("is_active"), bit)).alias("active"),
        F.bitmap_construct_agg(F.when(F.col("events_28d") > 0, bit)).alias("used"))


def append(spark: SparkSession, root: str, new_rows: DataFrame, label: str) -> None:
    """Add rows that no earlier append has seen. Only they are read, and what they come
    to is written under ``label``; the same label again replaces it."""
    if not label or "/" in label or "=" in label:
        raise ValueError("an append needs a name without / and =")
    for name, part in (("sums", sums_of(new_rows)), ("bitmaps", bitmaps_of(new_rows))):
        part.write.mode("overwrite").parquet(f"{root.rstrip('/')}/{name}/append={label}")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    # an append that died has no _SUCCESS
    folder = f"{root.rstrip('/')}/{name}"
    done = [f"{folder}/{n}" for n in published._names(spark, folder) if n.startswith("append=")
            and "_SUCCESS" in published._names(spark, f"{folder}/{n}")]
    return spark.read.parquet(*done)


def united(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """Distinct customers per ``keys``: bitmaps of a block are united, then counted."""
    counts = bitmaps.groupBy(*keys, "block").agg(*[
        F.bitmap_count(F.bitmap_or_agg(c)).alias(c) for c in BITMAPS])
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in BITMAPS])


def as_cube(spark: SparkSession, root: str) -> DataFrame:
    """The rows of scope month and plan of ``cube.month_cube``, from all appends."""
    sums, bitmaps = _read(spark, root, "sums"), _read(spark, root, "bitmaps")
    names = {"active": "active_customers", "everyone": "total_customers", "used": "used_customers"}
    out = None
    for scope, keys in (("month", ["month_date"]), ("plan", ["month_date", "plan"])):
        added = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in cube.COUNTS + cube.SUMS])
        found = united(bitmaps, *keys).select(*[F.col(k).alias(f"k_{k}") for k in keys], *BITMAPS)
        same = [added[k].eqNullSafe(found[f"k_{k}"]) for k in keys]
        rows = added.join(found, same, "left").select(
            "month_date", F.lit(scope).alias("scope"),
            (F.col("plan") if scope == "plan" else F.lit(None).cast("string")).alias("value"),
            *[F.coalesce(c, F.lit(0)).alias(n) for c, n in names.items()], *cube.COUNTS, *cube.SUMS)
        out = rows if out is None else out.unionByName(rows)
    return out
