"""All queries over the standard tables, with their oracle SQL."""

from __future__ import annotations

from lexaudit.plans import queries_metrics, queries_review, queries_streaming, queries_workflow
from lexaudit.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "queries_metrics", "queries_review", "queries_streaming", "queries_workflow"]
