"""Profiling, metrics, statistics and validation of wide fact tables on Spark."""

from plumbline.operators.spec import MetricSpec

__all__ = ["MetricSpec"]
