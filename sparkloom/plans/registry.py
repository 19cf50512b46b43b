"""Named queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

from . import check_queries, graph_queries, report_queries, table_queries, text_queries

_PARTS = (graph_queries, table_queries, check_queries, report_queries, text_queries)


def queries():
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
