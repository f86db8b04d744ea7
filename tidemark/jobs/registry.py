"""All queries of the library by name, with SQL for the same rows where SQL can express them."""

from __future__ import annotations

from tidemark.jobs import queries_matrix, queries_results, queries_scores, queries_selection

QUERIES: dict = {}
SQL: dict = {}
for _module in (queries_matrix, queries_scores, queries_selection, queries_results):
    QUERIES |= _module.REGISTER.queries
    SQL |= _module.REGISTER.sql
