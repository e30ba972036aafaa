"""Import every query module so the registry is filled."""

from tallyhawk.plans import document_queries, intake_queries, invoice_queries, question_queries  # noqa: F401
from tallyhawk.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
