"""All queries of the library but those of the package for training data."""

from tidemark.plans import audit_queries, catalogue, intake_queries, landed_queries, model_queries
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "audit_queries", "catalogue", "intake_queries", "landed_queries", "model_queries"]
