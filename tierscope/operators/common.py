"""Helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tierscope.functions.expr import PLAN_TEXT_ORDER, plan_from_text_code


def unknown_plans() -> Column:
    """Aggregate: the plan values outside the known tiers (normally none, so the
    set stays empty), for ``text_max_plan``."""
    plan = F.col("plan")
    return F.collect_set(F.when(~plan.isin(*PLAN_TEXT_ORDER), plan))


def text_max_plan(code: str, unknown: str) -> Column:
    """``MAX(plan)`` by text from MAX(plan_text_code(plan)), a hash aggregate over
    integers, and ``unknown_plans()`` of the same rows."""
    return F.greatest(plan_from_text_code(code), F.array_max(unknown))
