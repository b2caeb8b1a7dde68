"""Reports, and the registry of runnable queries with their SQL counterparts."""

from weftline.plans import dataset_queries, report_queries, retrieval_queries, scoring_queries  # noqa: F401
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
