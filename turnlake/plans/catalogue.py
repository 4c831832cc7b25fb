"""All queries of the library with their SQL."""

from turnlake.plans import model_queries, more_queries  # noqa: F401  (they register their queries)
from turnlake.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
