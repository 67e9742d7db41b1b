"""Importing this module registers every query."""

from clickloom.plans import event_queries, recommender_queries, serving_queries, stream_queries  # noqa: F401
from clickloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
