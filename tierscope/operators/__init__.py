"""Metric, report and data-quality operators over the base table."""

from tierscope.operators import (growth, latest, quality, quantile, report, revenue, segments,
                                 usage)

__all__ = ["growth", "latest", "quality", "quantile", "report", "revenue", "segments",
           "usage"]
