"""All queries of the engine, by name, and their SQL."""

from __future__ import annotations

from spanloom.plans import annotate_queries, coverage_queries, interval_queries, io_queries, match_queries, protocol_queries, review_queries, round_queries, scalar_queries, stage_queries, usage_queries

_MODULES = (interval_queries, match_queries, coverage_queries, scalar_queries, usage_queries, protocol_queries, stage_queries, round_queries, annotate_queries, review_queries, io_queries)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
