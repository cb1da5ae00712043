"""Registered queries: name -> (Spark query, SQL for the same rows or None)."""

from __future__ import annotations

from trustkpi.queries import chart_queries, clean_queries, fact_queries, kpi_queries, tool_queries

ALL = {
    **kpi_queries.QUERIES,
    **chart_queries.QUERIES,
    **clean_queries.QUERIES,
    **fact_queries.QUERIES,
    **tool_queries.QUERIES,
}
