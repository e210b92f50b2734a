"""All queries of the document engine: importing this registers them."""

from gleanery.plans import index_queries, job_queries, queries, record_queries, view_queries  # noqa: F401
from gleanery.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
