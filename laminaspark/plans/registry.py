"""All queries of the library's own operators, with their SQL."""

from laminaspark.plans import file_queries, grid_queries, scalar_queries  # noqa: F401  (registers)
from laminaspark.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
