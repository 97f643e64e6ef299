"""The registered queries over the given tables, with their SQL counterparts."""

from catalog import (  # noqa: F401
    answer_queries, doc_queries, expr_queries, meta_queries, search_queries, site_queries, source_queries,
)
from catalog.registry import ORACLES, QUERIES, forget

__all__ = ["ORACLES", "QUERIES", "forget"]
