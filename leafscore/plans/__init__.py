"""Domain views over the test tables, the query registry and its SQL oracles."""

from leafscore.plans import audit_queries, decision_queries, extraction_queries, matrix_queries, ops_queries, scoring_queries, stream_queries  # noqa: F401
from leafscore.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
