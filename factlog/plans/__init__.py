"""Queries: clauses over facts, composed into one DataFrame plan."""

from .query import Query, call, compare, not_, or_, rule

__all__ = ["Query", "call", "compare", "not_", "or_", "rule"]
