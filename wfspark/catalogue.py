"""Named queries over the driver's tables, and their SQL."""

from wfspark.plans import causal, graph, models, people, series, temporal  # noqa: F401
from wfspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
