"""Column expressions shared by the operators.

All are built-in Spark expressions (JVM side, inside whole-stage codegen);
there is no Python UDF anywhere in the library.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# The plan tiers and their ordinal rank, as in the reference.
PLAN_ORDER = ["Free", "Trial", "Low", "Middle", "Top"]
FREE_TIERS = ["Free", "Trial"]

# The two upgrade classes of the referral report.
FREE_TO_PAID = "Free/Trial → Paid"
PAID_UPGRADE = "Paid Tier Upgrade"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plan_rank(plan="plan") -> Column:
    """Free=1 < Trial=2 < Low=3 < Middle=4 < Top=5; NULL for anything else."""
    p = col(plan)
    expr = None
    for i, name in enumerate(PLAN_ORDER, start=1):
        expr = F.when(p == name, F.lit(i)) if expr is None else expr.when(p == name, F.lit(i))
    return expr


def plan_sort_key(plan="plan") -> Column:
    """Sort key for ``ORDER BY CASE plan ...`` (PostgreSQL: unknown plans last)."""
    return plan_rank(plan).asc_nulls_last()


def desc_pg(c) -> Column:
    """PostgreSQL ``ORDER BY x DESC``: NULLs first."""
    return col(c).desc_nulls_first()


def asc_pg(c) -> Column:
    """PostgreSQL ``ORDER BY x``: NULLs last."""
    return col(c).asc_nulls_last()


def int_div(a: Column, b: Column) -> Column:
    """Exact integral division (SQL ``div``), truncating toward zero."""
    return F.call_function("div", a, b)


def round_div(num, den, scale: int) -> Column:
    """``ROUND(num / den, scale)`` with PostgreSQL numeric semantics, as DOUBLE.

    Exact: half away from zero on the true quotient, computed with integer
    arithmetic on DECIMAL(38, 0), so no double rounding (``AVG`` of a decimal
    is already rounded to a few places; a double average loses digits past
    2^53). ``num`` may be a DECIMAL with up to ``scale`` fractional digits or
    an integer; ``den`` is a count. NULL when ``den`` is 0 or NULL (NULLIF).
    """
    num = col(num)
    den = col(den).cast("decimal(38,0)")
    p = 10 ** scale
    # exact: num is an integer or has at most ``scale`` (<= 6) fractional places
    scaled = (num.cast("decimal(38,6)") * F.lit(p)).cast("decimal(38,0)")
    q = int_div(F.abs(scaled) * 2 + F.abs(den), F.abs(den) * 2)
    sign = F.when((scaled < 0) != (den < 0), F.lit(-1)).otherwise(F.lit(1))
    res = (sign * q).cast("double") / F.lit(float(p))
    return F.when(den != 0, res)


def round_avg(sum_col, count_col, scale: int) -> Column:
    """Average from an exact sum and a count, rounded like ``ROUND(AVG(x), s)``."""
    return round_div(sum_col, count_col, scale)


def exact_sum(c) -> Column:
    """SUM of an integer column as DECIMAL(38,0), exact in every mode.

    The value is cut into three limbs of 20 bits (the top one signed) whose
    BIGINT sums stay fixed-width hash-aggregate buffers and can't overflow below
    2^40 rows; the limbs are put together once per group. A DECIMAL(38,0) sum
    would add BigDecimal objects row by row.
    """
    x = col(c).cast("bigint")
    mask = F.lit((1 << 20) - 1)
    limbs = [F.shiftright(x, 40), F.shiftright(x, 20).bitwiseAND(mask), x.bitwiseAND(mask)]
    out = None
    for limb, power in zip(limbs, (40, 20, 0)):
        part = F.sum(limb).cast("decimal(20,0)") * F.lit(Decimal(1 << power))
        out = part if out is None else out + part
    return out.cast("decimal(38,0)")


def cents(c) -> Column:
    """Money (DECIMAL(18,2)) as integer cents, exact over the whole type."""
    return (col(c).cast("decimal(18,2)") * F.lit(Decimal(100))).cast("bigint")


def cents_sum(c) -> Column:
    """Exact SUM of money, in cents (see ``exact_sum``)."""
    return exact_sum(cents(c))


def from_cents(c) -> Column:
    """Cents back to money as DOUBLE: the double nearest to the exact decimal."""
    return (col(c).cast("decimal(34,0)") * F.lit(Decimal("0.01"))).cast("double")


def money_avg(cents_total, count) -> Column:
    """``ROUND(AVG(money), 2)`` from a cents sum and a count, exact, DOUBLE."""
    return round_div(cents_total, count, 0) / F.lit(100.0)


def pct(part, whole, scale: int = 2) -> Column:
    """``ROUND(100.0 * part / NULLIF(whole, 0), scale)`` exactly, as DOUBLE."""
    return round_div(col(part).cast("decimal(38,0)") * 100, whole, scale)


def round_half_up_double(c, scale: int = 0) -> Column:
    """``ROUND(x::numeric, s)`` for a DOUBLE input (e.g. a median). Spark's
    ``round`` on doubles rounds half up on the shortest decimal form, which
    is what the cast to numeric does too."""
    return F.round(col(c), scale)


def whole_months(later, earlier) -> Column:
    """Signed whole months between two dates, like PostgreSQL's
    ``EXTRACT(YEAR FROM AGE(a, b)) * 12 + EXTRACT(MONTH FROM AGE(a, b))``.

    AGE counts calendar months and borrows one when the day of month of the
    later date is smaller. ``floor(months_between)`` differs for month ends
    (it treats two month-ends as a whole month), so it is not used.
    """
    a, b = col(later).cast("date"), col(earlier).cast("date")
    hi, lo = F.greatest(a, b), F.least(a, b)   # both skip NULLs, hence the guard below
    mag = ((F.year(hi) - F.year(lo)) * 12 + F.month(hi) - F.month(lo)
           - F.when(F.dayofmonth(hi) < F.dayofmonth(lo), 1).otherwise(0))
    # AGE with a NULL argument is NULL
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a < b, -mag).otherwise(mag))


def years_from_months(months) -> Column:
    """``ROUND(years + months / 12.0, 1)`` where years and months come from one
    AGE value: that is the whole-month count / 12, rounded half away from zero."""
    return round_div(col(months), F.lit(12), 1)


def day_number(c) -> Column:
    """A date as a BIGINT from 0 to 2^32 - 1 in the order of dates (any 32-bit day)."""
    return F.unix_date(col(c)).cast("bigint") + (1 << 31)


def date_of_day_number(n) -> Column:
    return F.date_from_unix_date((col(n) - (1 << 31)).cast("int"))


def sign_up_code() -> Column:
    """M05's order of a customer's rows as one number: month (NULL last), creation date,
    first paid date (NULL first); NULL without a creation date. Unlike the minimum of a
    struct, which makes Spark sort all rows, the minimum of numbers is a hash aggregate."""
    part = lambda c, bits: c.cast("decimal(10,0)") * F.lit(Decimal(1 << bits))
    month = F.when(F.col("month_date").isNull(), F.lit(1 << 32)).otherwise(day_number("month_date"))
    paid = F.when(F.col("first_paid_date").isNull(), F.lit(0).cast("bigint")).otherwise(day_number("first_paid_date") + 1)
    return F.when(F.col("account_created_date").isNotNull(), (
        part(month, 65) + part(day_number("account_created_date"), 33) + paid.cast("decimal(10,0)")).cast("decimal(38,0)"))


def sign_up_of(code) -> Column:
    """``sign_up_code`` back as a struct in the same order."""
    c = col(code)
    month = int_div(c, F.lit(Decimal(1 << 65)))
    created = int_div(c % F.lit(Decimal(1 << 65)), F.lit(Decimal(1 << 33)))
    paid = (c % F.lit(Decimal(1 << 33))).cast("bigint")
    unknown = month == F.lit(1 << 32)
    return F.when(c.isNotNull(), F.struct(
        unknown.alias("no_month"), F.when(~unknown, date_of_day_number(month)).alias("month_date"),
        date_of_day_number(created).alias("account_created_date"),
        F.when(paid > 0, date_of_day_number(paid - 1)).alias("first_paid_date")))


def nullif_blank(c) -> Column:
    """NULL for NULL or '' (the reference treats both as missing)."""
    c = col(c)
    return F.when(c.isNotNull() & (c != ""), c)


# Known plan names in text (binary collation) order: MAX(plan) over known
# names is the name with the largest position in this list.
PLAN_TEXT_ORDER = sorted(PLAN_ORDER)


def plan_text_code(plan="plan") -> Column:
    """1-based position of a known plan name in text order; NULL otherwise.

    Lets MAX(plan)/MIN(plan) by text run as an integer hash aggregate instead
    of a sort-based aggregate over strings."""
    p = col(plan)
    expr = None
    for i, name in enumerate(PLAN_TEXT_ORDER, start=1):
        expr = F.when(p == name, F.lit(i)) if expr is None else expr.when(p == name, F.lit(i))
    return expr


def _name_of(code, names) -> Column:
    # A CASE chain, not element_at(array(...), code): Spark 4.1 mis-evaluates
    # element_at over a literal array when the index is NULL.
    c = col(code)
    expr = None
    for i, name in enumerate(names, start=1):
        expr = F.when(c == i, F.lit(name)) if expr is None else expr.when(c == i, F.lit(name))
    return expr


def plan_from_text_code(code) -> Column:
    return _name_of(code, PLAN_TEXT_ORDER)


def plan_from_rank(rank) -> Column:
    return _name_of(rank, PLAN_ORDER)
