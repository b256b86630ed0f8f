"""All registered queries and the SQL that each is checked against."""

from __future__ import annotations

from opsframe.plans import catalog_queries, duplicate_queries, extraction_queries, matching_queries, monitoring_queries, page_queries, sink_queries

_MODULES = (monitoring_queries, catalog_queries, duplicate_queries, extraction_queries, matching_queries, page_queries, sink_queries, extraction_queries)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.oracle_sql().items()}
