"""Latest-month and last-n-months selections.

These are scalar subqueries (``DataFrame.scalar()``), like the reference's
``month_date = (SELECT max(month_date) ...)``. On a table partitioned by
``month_date`` Spark evaluates the subquery first and uses the result as a
partition filter, so only the selected months are read. The subquery itself
reads the month list that ``sources.base_table`` keeps beside a stored table
(one row per month); a frame without one is asked for its months.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MONTHS: WeakKeyDictionary = WeakKeyDictionary()


def with_months(df: DataFrame, months: DataFrame) -> DataFrame:
    """Let the operators take the months of ``df`` from ``months`` (columns
    month_date, rows; one row per distinct month, a NULL month included)."""
    _MONTHS[df] = months
    return df


def months_of(df: DataFrame) -> DataFrame:
    """``(month_date, rows)``: the month list, or else counted from the rows."""
    found = _MONTHS.get(df)
    return found if found is not None else df.groupBy("month_date").agg(F.count("*").alias("rows"))


def max_month(df: DataFrame) -> Column:
    """``(SELECT MAX(month_date) FROM T)`` as a Column."""
    return months_of(df).select(F.max("month_date")).scalar()


def previous_month(df: DataFrame) -> Column:
    """The latest month before the last one."""
    months = months_of(df)
    last = months.select(F.max("month_date")).scalar()
    return months.filter(F.col("month_date") < last).select(F.max("month_date")).scalar()


def nth_latest_month(df: DataFrame, n: int) -> Column:
    """The n-th largest distinct month (the smallest of the last n)."""
    # PostgreSQL's DESC puts a NULL month first, where it takes one of the n
    # slots (and then matches no row); the min below skips it.
    last_n = (months_of(df).select("month_date")
              .orderBy(F.col("month_date").desc_nulls_first()).limit(n))
    return last_n.select(F.min("month_date")).scalar()


def latest_rows(df: DataFrame) -> DataFrame:
    """Rows of the table-wide latest month (quirk K12: not the latest month
    that has active rows)."""
    return df.filter(F.col("month_date") == max_month(df))


def recent_rows(df: DataFrame, n: int) -> DataFrame:
    """Rows whose month is one of the last ``n`` distinct months present
    (quirk K11: months present, not calendar months)."""
    return df.filter(F.col("month_date") >= nth_latest_month(df, n))
