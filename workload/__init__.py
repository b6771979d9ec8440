"""The operators run over the given tables; each query has a SQL twin where SQL can express it."""

from workload import answer_queries, catalog_queries, feature_queries, record_queries, text_queries  # noqa: F401
from workload.base import QUERIES, TWINS

__all__ = ["QUERIES", "TWINS"]
