"""All core queries by name, with their SQL."""

from __future__ import annotations

from tessera.plans import catalog_queries, extract_queries, graph_queries, library_queries, quality_queries, retrieval_queries, skew_queries, structure_queries, telemetry_queries

FLAGSHIP = "latency_series"

_MODULES = [telemetry_queries, retrieval_queries, extract_queries, graph_queries, quality_queries, catalog_queries, skew_queries, structure_queries, library_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
