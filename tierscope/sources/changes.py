"""What two snapshots of the base table differ in, and what that touches.

Corrections reach a table as edits and deletions of old rows. Rows are compared as a
multiset by their key (customer, month) and two 64-bit hashes of their values: both
snapshots are counted per key and hash (combined map-side, so a customer with very
many rows costs what its different rows cost), put together, and counted again; no
row of one snapshot is joined to the other, and NULL keys need no special case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierscope.sources.base_table import conform
from tierscope.sources.schema import COLUMNS


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, month_date, kind, old_rows, new_rows, removed, added)`` of every key whose
    rows differ; kind is ``inserted`` or ``deleted`` if only one snapshot has the key, else
    ``changed``. Repeated rows count as often as they occur."""
    def counted(df, side):
        values = [F.col(c) for c in COLUMNS]
        # a marker for each NULL keeps (NULL, x) apart from (x, NULL)
        marks = [F.col(c).isNull() for c in COLUMNS]
        return conform(df).groupBy("id", "month_date", F.xxhash64(*values, *marks).alias("h1"),
                                   F.xxhash64(F.lit(1), *values, *marks).alias("h2")).agg(F.count("*").alias("n")).select(
            "id", "month_date", "h1", "h2", *[(F.col("n") if s == side else F.lit(0).cast("bigint")).alias(s)
                                              for s in ("old_rows", "new_rows")])

    both = counted(old, "old_rows").unionByName(counted(new, "new_rows"))
    rows = both.groupBy("id", "month_date", "h1", "h2").agg(F.sum("old_rows").alias("o"), F.sum("new_rows").alias("n"))
    zero = F.lit(0).cast("bigint")
    keys = rows.groupBy("id", "month_date").agg(
        F.sum("o").alias("old_rows"), F.sum("n").alias("new_rows"),
        F.sum(F.greatest(F.col("o") - F.col("n"), zero)).alias("removed"),
        F.sum(F.greatest(F.col("n") - F.col("o"), zero)).alias("added"))
    kind = F.when(F.col("old_rows") == 0, "inserted").when(F.col("new_rows") == 0, "deleted").otherwise("changed")
    return keys.where("removed + added > 0").select("id", "month_date", kind.alias("kind"), "old_rows", "new_rows",
                                                    "removed", "added")


def touched_months(changes: DataFrame) -> DataFrame:
    return changes.select("month_date").distinct()


def touched_customers(changes: DataFrame) -> DataFrame:
    return changes.select("id").distinct()


def by_month(changes: DataFrame) -> DataFrame:
    """Changed keys and rows per month and kind."""
    return changes.groupBy("month_date", "kind").agg(
        F.count("*").alias("keys"), F.sum("removed").alias("removed"), F.sum("added").alias("added"))
