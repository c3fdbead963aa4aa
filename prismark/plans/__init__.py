"""Queries over the driver's tables and the same in SQL."""

from prismark.plans.queries import oracle_sql, queries, text_code_of_documents

__all__ = ["oracle_sql", "queries", "text_code_of_documents"]
