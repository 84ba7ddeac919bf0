"""The registry of core queries and their SQL."""

from __future__ import annotations

from gleanery.plans import file_queries, label_queries, metric_queries, nested_queries, record_queries, report_queries, search_queries

MODULES = (nested_queries, label_queries, metric_queries, record_queries, search_queries, report_queries, file_queries)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in MODULES for name, text in m.SQL.items()}
