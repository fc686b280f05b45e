"""Registered queries over the stored tables, each with SQL that must give the same rows."""

from plumbline.queries.registry import ORACLES, QUERIES
from plumbline.queries import (  # noqa: F401  (importing registers the queries)
    ingestion,
    metrics,
    profiling,
    results,
    series,
    statistics,
)

__all__ = ["ORACLES", "QUERIES"]
