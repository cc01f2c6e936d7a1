"""Named queries over the driver's tables."""

from cadenza.plans import browse_queries, io_queries, link_queries, merge_queries, more_queries, quality_queries, text_queries  # noqa: F401
from cadenza.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
