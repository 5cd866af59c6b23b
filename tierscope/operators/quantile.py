"""Exact median of an integer column per group, with bounded task memory.

Spark's exact ``percentile`` keeps a value->count map per group and merges
every map task's partial map for a group in one task, so with few groups
(six plans) the whole table's distinct values meet in six tasks. Here:

1. a histogram ``(group, value) -> count`` is an ordinary hash aggregate,
   spread over all tasks and combined map-side (a hot value costs one row
   per map task);
2. the rank(s) of the median inside each group are found by a radix descent
   over the 64-bit value in three digits of 22/21/21 bits: at each level the
   histogram is summed per digit within the digit prefix chosen so far, and
   a running count over those digits (a window per group and target, at most
   2^22 rows) picks the digit holding the target rank. The first level also
   yields each group's size, so no separate count pass is needed.

Every step joins the histogram with at most two targets per group (map-side
while Spark finds them small), and every window holds at most 2^22 rows,
whatever the table size. The result equals ``percentile_cont(0.5)``: the
mean of the values at 0-based ranks floor((n-1)/2) and floor(n/2).

Meant for few, large groups (M06: six plans). With many small groups, each
group's values are few and Spark's own ``percentile`` is the simpler choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Radix digits over a signed 64-bit value: (shift, width). Arithmetic shifts
# keep the order of negative values.
_LEVELS = [(42, 22), (21, 21), (0, 21)]


def _digit(v, level: int):
    """Digit ``level`` of v: the top digit keeps its sign, the others are masked."""
    shift, width = _LEVELS[level]
    d = F.shiftright(v, shift)
    return d if level == 0 else d.bitwiseAND(F.lit((1 << width) - 1))


def exact_median(df: DataFrame, group, value: str, out: str = "median") -> DataFrame:
    """Per ``group`` (a column name or a list of them; NULL is a group value),
    the exact median of non-NULL integer ``value`` as DOUBLE; groups with no
    value are absent."""
    groups = [group] if isinstance(group, str) else list(group)
    g, v = "_g", "_v"
    rows = df.select(F.struct(*groups).alias(g), F.col(value).cast("bigint").alias(v)) \
        .filter(F.col(v).isNotNull())
    return _median(rows.groupBy(g, v).agg(F.count("*").alias("_c")), groups, out)


def median_of_histogram(hist: DataFrame, group, value: str, count: str, out: str = "median") -> DataFrame:
    """``exact_median`` from stored histograms: rows ``(group, value, count)``, several
    of one group and value are added up."""
    groups = [group] if isinstance(group, str) else list(group)
    rows = hist.select(F.struct(*groups).alias("_g"), F.col(value).cast("bigint").alias("_v"), F.col(count).alias("_c"))
    return _median(rows.filter(F.col("_v").isNotNull()).groupBy("_g", "_v").agg(F.sum("_c").alias("_c")), groups, out)


def _median(hist: DataFrame, groups: list[str], out: str) -> DataFrame:
    """Radix descent over a histogram ``(_g, _v, _c)``."""
    g, v = "_g", "_v"

    # Level 0 needs no targets yet: per group, the first-digit counts give
    # both the running count and the group size n (one aggregation, one
    # window partitioned by group over at most 2^22 digits).
    d0 = hist.withColumn("_d0", _digit(F.col(v), 0)).groupBy(g, "_d0") \
        .agg(F.sum("_c").alias("_dc"))
    upto = (Window.partitionBy(g).orderBy("_d0")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d0 = (d0.withColumn("_cum", F.sum("_dc").over(upto))
          .withColumn("_n", F.sum("_dc").over(Window.partitionBy(g))))
    d0 = d0.select(g, "_d0", "_dc", "_cum", F.explode(F.array(
        F.struct(F.lit(0).alias("_which"), F.floor((F.col("_n") - 1) / 2).alias("_k")),
        F.struct(F.lit(1).alias("_which"), F.floor(F.col("_n") / 2).alias("_k")))).alias("t"))
    d0 = d0.select(g, "_d0", "_dc", "_cum", "t._which", F.col("t._k").cast("bigint").alias("_k"))
    before = F.col("_cum") - F.col("_dc")
    targets = (d0.filter((before <= F.col("_k")) & (F.col("_k") < F.col("_cum")))
               .select(g, "_which", (F.col("_k") - before).alias("_k"), "_d0"))

    prefix_cols: list[str] = ["_d0"]
    for level in range(1, len(_LEVELS)):
        dcol = f"_d{level}"
        h = hist
        for i in range(level + 1):
            h = h.withColumn(f"_d{i}", _digit(F.col(v), i))
        keys = [g] + prefix_cols
        # null-safe equality on the group key (a struct: NULL fields match).
        # At most two target rows per group (24 for M06's plans x measures), so
        # AQE broadcasts them by measured size. With very many groups it joins by
        # group and digits, which spreads a group's histogram over its digits.
        t, hh = targets.alias("t"), h.alias("h")
        cond = [F.col(f"t.{g}").eqNullSafe(F.col(f"h.{g}"))] + \
            [F.col(f"t.{c}").eqNullSafe(F.col(f"h.{c}")) for c in prefix_cols]
        # (digits are never NULL; a plain equality would add IS NOT NULL filters
        # below the histogram, different ones at each level, and so recompute it)
        joined = t.join(hh, cond, "inner").select(
            *[F.col(f"t.{c}").alias(c) for c in keys], F.col("t._which").alias("_which"),
            F.col("t._k").alias("_k"), F.col(f"h.{dcol}").alias(dcol), F.col("h._c").alias("_c"))
        if level == len(_LEVELS) - 1:
            # last digit: one histogram row per value, already unique per digit
            per_digit = joined.withColumnRenamed("_c", "_dc")
        else:
            per_digit = joined.groupBy(*keys, "_which", "_k", dcol).agg(F.sum("_c").alias("_dc"))
        w = (Window.partitionBy(g, "_which").orderBy(dcol)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cum = per_digit.withColumn("_cum", F.sum("_dc").over(w))
        before = F.col("_cum") - F.col("_dc")
        pick = cum.filter((before <= F.col("_k")) & (F.col("_k") < F.col("_cum")))
        targets = pick.select(*keys, "_which", (F.col("_k") - before).alias("_k"), dcol)
        prefix_cols = prefix_cols + [dcol]

    # rebuild the value from its digits
    val = None
    for level, (shift, _) in enumerate(_LEVELS):
        part = F.shiftleft(F.col(f"_d{level}").cast("bigint"), shift)
        val = part if val is None else val.bitwiseOR(part)
    vals = targets.select(g, "_which", val.alias("_val"))
    med = vals.groupBy(g).agg(
        ((F.max(F.when(F.col("_which") == 0, F.col("_val"))).cast("double")
          + F.max(F.when(F.col("_which") == 1, F.col("_val"))).cast("double")) / 2).alias(out))
    return med.select(*[F.col(f"{g}.{c}").alias(c) for c in groups], out)
