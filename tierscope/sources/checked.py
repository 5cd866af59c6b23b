"""Writing and reading with the data-quality checks on the way.

``publish_base_table`` takes R01's and R02's counts from the rows as they are written
(``DataFrame.observe``: no scan of its own) and publishes the table only if they keep
the rules. ``read_text`` splits CSV or JSON files into rows and quarantined records.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierscope.functions.expr import PLAN_ORDER
from tierscope.operators.latest import months_of
from tierscope.sources import published
from tierscope.sources.base_table import conform, read_base_table, write_base_table
from tierscope.sources.schema import BASE_SCHEMA

CHECKED_COLUMNS = ("country", "industry")
RECORD = "_record"


class QualityBreach(ValueError):
    """Rules that a table breaks; it was not published."""


@dataclass
class Rules:
    """Limits for publishing; shares are of all rows. ``most_missing`` may name any of
    ``CHECKED_COLUMNS``."""
    fewest_rows: int = 1
    most_missing: dict[str, float] = field(default_factory=dict)
    most_free_with_arr: float = 1.0
    most_without_key: float = 0.0

    def breaches(self, m: dict) -> list[str]:
        n = m["records"]
        share = lambda x: x / n if n else 0.0
        out = [f"{n} rows, fewer than {self.fewest_rows}"] if n < self.fewest_rows else []
        for c, most in self.most_missing.items():
            if share(m[f"{c}__null"] + m[f"{c}__blank"]) > most:
                out.append(f"{c} is missing in more than {most:.0%} of the rows")
        if share(m["free_with_arr"]) > self.most_free_with_arr:
            out.append(f"more than {self.most_free_with_arr:.0%} of the rows are Free with revenue")
        if share(m["without_key"]) > self.most_without_key:
            out.append(f"more than {self.most_without_key:.0%} of the rows have no customer or month")
        return out


def _metrics() -> list:
    """R01's counts and R02's, over all rows and per known plan, plus R03's rows and rows without a key."""
    out = [F.count(F.lit(1)).alias("records"), F.min("month_date").alias("first_month"), F.max("month_date").alias("last_month"),
           F.count_if((F.col("plan") == "Free") & (F.col("annual_recurring_revenue") > 0)).alias("free_with_arr"),
           F.count_if(F.col("id").isNull() | F.col("month_date").isNull()).alias("without_key")]
    scopes = [("", F.lit(True))] + [(f"__{p}", F.col("plan") == p) for p in PLAN_ORDER]
    for name, rows in scopes:
        if name:
            out.append(F.count_if(rows).alias(f"records{name}"))
        for c in CHECKED_COLUMNS:
            out += [F.count_if(rows & F.col(c).isNull()).alias(f"{c}__null{name}"),
                    F.count_if(rows & (F.col(c) == "")).alias(f"{c}__blank{name}")]
    return out


def publish_base_table(df: DataFrame, root: str, rules: Rules | None = None) -> dict:
    """Write ``df`` as a version under ``root`` and switch readers to it if it keeps
    ``rules``; the counts taken on the way. Otherwise ``QualityBreach``, and readers keep
    the version before.

    A stage that runs again after an executor was lost may count rows twice, so the
    counts are only trusted if their total is that of the written month list; else
    they are taken from the written files."""
    spark, found = df.sparkSession, {}

    def write(folder: str) -> None:
        seen = Observation("quality")
        write_base_table(conform(df).observe(seen, *_metrics()), f"{folder}/table")
        found.update(seen.get)
        if found["records"]:
            table = read_base_table(spark, f"{folder}/table")
            if found["records"] != months_of(table).agg(F.sum("rows")).first()[0]:
                found.update(table.agg(*_metrics()).first().asDict())
        if broken := (rules or Rules()).breaches(found):
            raise QualityBreach("; ".join(broken))

    published.publish(spark, root, write)
    return found


def read_published_table(spark: SparkSession, root: str) -> DataFrame:
    """The base table that is current now, with its month list."""
    return read_base_table(spark, f"{published.current(spark, root)}/table")


def read_text(spark: SparkSession, path: str, fmt: str, **options: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, quarantined)`` of CSV or JSON files: rows that fit the base schema and have
    a customer and a month, and ``(record, reason)`` of all others, the record as it stands in
    the file. Every record is in one of the two."""
    if fmt not in ("csv", "json"):
        raise ValueError("csv or json")
    schema = T.StructType([*BASE_SCHEMA.fields, T.StructField(RECORD, T.StringType())])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    reader = spark.read.format(fmt).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RECORD)
    if fmt == "csv":
        reader = reader.option("header", "true").option("enforceSchema", "false")
    read = reader.options(**options).load(path)
    values = F.to_json(F.struct(*[F.col(f.name) for f in BASE_SCHEMA.fields]))
    reason = (F.when(F.col(RECORD).isNotNull(), "unreadable").when(F.col("id").isNull(), "no id")
              .when(F.col("month_date").isNull(), "no month_date"))
    judged = read.withColumn("reason", reason)
    return (conform(judged.where("reason IS NULL")),
            judged.where("reason IS NOT NULL").select(F.coalesce(RECORD, values).alias("record"), "reason"))
