"""Physical-plan checks: the properties each operator is designed to have
(no Python evaluation, partition pruning on the month, top-k without a full
sort, map-side limits) asserted from Spark's own plan text."""

from __future__ import annotations

from pyspark.sql import DataFrame

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "MapInPandas", "FlatMapGroupsInArrow", "MapInArrow", "PythonUDF")


def physical_plan(df: DataFrame) -> str:
    """Physical plan text as Spark prints it (``explain(mode="formatted")``)."""
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def executed_plan(df: DataFrame) -> str:
    """The plan text after execution, with AQE's final choices (runs the query)."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def uses_python(df: DataFrame) -> bool:
    text = physical_plan(df)
    return any(n in text for n in PYTHON_NODES)


def has_node(df: DataFrame, node: str) -> bool:
    return node in physical_plan(df)


def partition_filters(df: DataFrame) -> list[str]:
    """The ``PartitionFilters`` lines of every file scan."""
    return [line.strip() for line in physical_plan(df).splitlines()
            if line.strip().startswith("PartitionFilters")]


def pushed_filters(df: DataFrame) -> list[str]:
    return [line.strip() for line in physical_plan(df).splitlines()
            if line.strip().startswith("PushedFilters")]


def exchanges(df: DataFrame) -> int:
    """Number of shuffle exchanges in the (pre-AQE) physical plan."""
    return sum(1 for line in physical_plan(df).splitlines()
               if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line
               or "Exchange SinglePartition" in line)
