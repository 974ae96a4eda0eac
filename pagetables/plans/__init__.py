"""Named queries over the operators, each with its SQL twin where there is one."""

from pagetables.plans import corpus_queries, depth_queries, feed_queries, page_queries, scale_queries, usage_queries  # noqa: F401
from pagetables.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
