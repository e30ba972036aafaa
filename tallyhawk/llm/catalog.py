"""Import every query module so the registry is filled."""

from tallyhawk.llm import corpus_queries, filter_queries, sequence_queries  # noqa: F401
from tallyhawk.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
