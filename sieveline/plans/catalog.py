"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from . import queries_metrics, queries_parsing, queries_records

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _module in (queries_records, queries_parsing, queries_metrics):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
