"""Registered queries."""

from . import analytics_queries, clean_queries, evidence_queries, index_queries, join_queries, published_queries, report_queries, row_queries, series_queries, source_queries, stream_queries, text_queries, validation_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
