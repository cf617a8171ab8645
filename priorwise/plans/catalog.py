"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from priorwise.plans import evaluation_queries, fit_queries, ingest_queries, matchup_queries, pair_queries, record_queries, report_queries, service_queries, window_queries
from priorwise.plans.views import nudged

_FAMILIES = (window_queries, pair_queries, evaluation_queries, ingest_queries, fit_queries, service_queries, record_queries, report_queries, matchup_queries)

QUERIES = {name: query for family in _FAMILIES for name, query in family.QUERIES.items()}
ORACLE_SQL = {name: nudged(sql) for family in _FAMILIES for name, sql in family.ORACLE_SQL.items()}
